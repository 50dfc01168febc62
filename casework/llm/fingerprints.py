"""Document fingerprints by consistent weighted sampling: signatures whose collision rate is the generalised Jaccard similarity.

The terms of a text are its runs of three words (the first two padded with a start mark, so that every text with a word
has terms), weighted by how often they occur. For each sample and term, gamma variables r, c and a uniform b are drawn
from a hash of both; with weight S, t = floor(ln S / r + b) and a = c exp(-r (t + 1 - b)); the term of smallest a, with its t,
is the sample (Ioffe 2010). Two texts take the same sample with probability sum(min) / sum(max) of their weights.

The gamma variables are sums of exponentials: c = e1 + e2, r = E + e3 with E = ln(c / e1), b = e3 / r. Then a term of weight 1
has a = e1, which orders as the hash itself, so the many terms that occur once need no logarithm and the few others get
the full formula. A text's whole signature takes one pass over its bytes in numpy, ``SAMPLES`` minima over its terms, and no
dictionary of words.

Defined results: null text counts as empty; texts without words (``[^\\x20\\x09-\\x0D]+``) have a fingerprint of zeros, alike among
themselves and unlike all others; words of more than 32 bytes count as pieces of 32 bytes; equal texts have equal fingerprints,
repeated rows and ids one result each; an empty table gives no rows; other columns are not read. For the next
document, null ids come first and rows with equal ids follow a hash of the text. Very long texts are taken whole; a step
holds at least one text and the one after.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casework.llm.common import column, map_arrow, materialize

SAMPLES = 128
#: Bytes of a word piece, text bytes per step, and texts per step (their number and a 52-bit term share a sort key).
PIECE, STEP_BYTES, STEP_TEXTS = 32, 1 << 19, 4096
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _draws(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, n, dtype=np.uint64)


_BYTE_HASH = _draws(PIECE * 256, 1)  # a word's hash is the sum of a number per place and byte
_PLACES = _draws(3, 2) | np.uint64(1)
_SEEDS = (_draws(2 * 4096, 3) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _mix32(x: np.ndarray, spare: np.ndarray | None = None) -> np.ndarray:
    """In place; ``spare`` is a buffer of the same length."""
    spare = np.empty_like(x) if spare is None else spare
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, None)):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        if factor:
            np.multiply(x, np.uint32(factor), out=x)
    return x


def _exponential(z: np.ndarray) -> np.ndarray:
    return -np.log((z + 0.5) / 2.0 ** 32)


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word (piece) of texts that lie one after the other and end at ``ends``."""
    solid = ~_SPACE[data]
    first = np.ones(len(data) + 1, bool)  # a word starts after a space and where a text starts
    first[1:] = False
    first[ends[ends < len(data)]] = True
    before = np.concatenate([[False], solid[:-1]])
    starts = np.flatnonzero(solid & (first[:-1] | ~before))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(solid)
    offset = np.searchsorted(at, starts)
    sizes = np.diff(offset, append=len(at))
    place = np.arange(len(at)) - np.repeat(offset, sizes)
    if int(sizes.max()) > PIECE:
        offset = np.flatnonzero(place % PIECE == 0)
        starts = at[offset]
        place %= PIECE
    h = np.add.reduceat(_BYTE_HASH[place * 256 + data[at]], offset)
    return _mix64(h), np.searchsorted(ends, starts, side="right")


def terms(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, 52-bit term and weight of every distinct term, by text."""
    h, text = words(data, ends)
    one = np.concatenate([np.zeros(2, np.uint64), h])
    same = np.concatenate([np.full(2, -1), text])
    term = h * _PLACES[0] + np.where(same[1:-1] == text, one[1:-1], np.uint64(0)) * _PLACES[1] \
        + np.where(same[:-2] == text, one[:-2], np.uint64(0)) * _PLACES[2]
    key = np.sort((text.astype(np.uint64) << np.uint64(52)) | (_mix64(term) >> np.uint64(12)))
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    weight = np.diff(start, append=len(key))
    key = key[start]
    return (key >> np.uint64(52)).astype(np.int64), key & np.uint64((1 << 52) - 1), weight


def _runs(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    return start, text[start]


def signatures(data: np.ndarray, ends: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """One row of 16-bit samples per text (zeros without words)."""
    text, term, weight = terms(data, ends)
    out = np.zeros((len(ends), samples), np.uint16)
    if not len(text):
        return out
    both = _mix64(term)
    low, high = (both & np.uint64(0xFFFFFFFF)).astype(np.uint32), (both >> np.uint64(32)).astype(np.uint32)
    once = weight == 1
    l_low, l_high = low[once], high[once]
    h_low, h_high, log_s = low[~once], high[~once], np.log(weight[~once])
    if len(l_low):
        l_start, l_text = _runs(text[once])
        x, y = np.empty_like(l_low), np.empty_like(l_low)
    if len(h_low):
        h_start, h_text = _runs(text[~once])
        h_size = np.diff(h_start, append=len(h_low))
    has = np.zeros(len(ends), bool)
    has[text] = True
    for d in range(samples):
        s1, s2 = _SEEDS[2 * d], _SEEDS[2 * d + 1]
        z, t, a = np.zeros(len(ends), np.uint32), np.zeros(len(ends), np.uint32), np.full(len(ends), np.inf)
        if len(l_low):
            np.multiply(l_low, s1, out=x)
            np.multiply(l_high, s2, out=y)
            np.add(x, y, out=x)
            least = np.minimum.reduceat(_mix32(x, y), l_start)
            z[l_text], a[l_text] = least, -np.log1p(-(least + 0.5) / 2.0 ** 32)
        if len(h_low):
            hz = _mix32(h_low * s1 + h_high * s2)
            z2 = _mix32((hz + h_high) * s2 + np.uint32(0x9E3779B9))
            e1, e2, e3 = -np.log1p(-(hz + 0.5) / 2.0 ** 32), _exponential(z2), _exponential(_mix32((z2 ^ h_low) * s1 + np.uint32(0x7F4A7C15)))
            c = e1 + e2
            r = np.log(c / e1) + e3
            b = e3 / r
            ht = np.floor(log_s / r + b)
            ha = c * np.exp(-r * (ht + 1 - b))
            best = np.repeat(np.minimum.reduceat(ha, h_start), h_size)
            win = np.flatnonzero(ha <= best)[::-1]  # of equal ones the first is written last
            w_text = np.repeat(h_text, h_size)[win]
            keep = ha[win] < a[w_text]
            win, w_text = win[keep], w_text[keep]
            z[w_text], t[w_text] = hz[win], ht[win].astype(np.uint32)
        v = _mix32(z ^ (t * np.uint32(0x9E3779B9))) >> np.uint32(16)
        out[:, d] = np.where(has, np.maximum(v, 1), 0)
    return out


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array without nulls, and where each text starts (one more at the end)."""
    _, offsets, values = texts.buffers()
    off = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def _steps(batches: Iterator[pa.RecordBatch], text: int = 1):
    """Rows in steps of bounded bytes and number, at least one text each."""
    for b in batches:
        t = pc.fill_null(pc.cast(b.column(text), pa.string()), "")
        step = np.maximum((np.cumsum(pc.binary_length(t).to_numpy().astype(np.int64)) - 1) // STEP_BYTES, 0)
        cuts = np.unique(np.concatenate([np.flatnonzero(np.diff(step)) + 1, np.arange(0, len(t), STEP_TEXTS // 2)])).tolist() + [len(t)]
        for i, j in zip(cuts[:-1], cuts[1:]):
            if j > i:
                yield b.slice(i, j - i), t.slice(i, j - i)


def _binary(rows: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(rows.astype(">u2"))
    return pa.array([r.tobytes() for r in raw], pa.binary())


def fingerprints(docs: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``fingerprint`` (four hex digits a sample) of every row, without moving the texts."""
    d = docs.select(column(docs, id_col).alias("doc_id"), column(docs, text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in _steps(batches):
            data, off = _bytes(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), _binary(signatures(data, off[1:], samples))], names=["doc_id", "sig"])
    out = map_arrow(d, run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, sig binary")
    return out.select("doc_id", F.lower(F.hex("sig")).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples of two fingerprints: estimates the generalised Jaccard similarity of their texts."""
    n = F.length(a) / 4
    same = F.filter(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.substring(a, i * 4 + 1, F.lit(4)) == F.substring(b, i * 4 + 1, F.lit(4)))
    return F.size(same) / n


def _head(raw: bytes, chars: int) -> bytes:
    """The first ``chars`` code points of UTF-8 bytes."""
    if chars <= 0:
        return b""
    a = np.frombuffer(raw, np.uint8)
    at = np.flatnonzero((a & 0xC0) != 0x80)
    return raw if chars >= len(at) else raw[:at[chars]]


def _chars(raw: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))


def _edited(raw: bytes, following: bytes) -> tuple[int, bytes]:
    n = _chars(raw)
    return n, _head(raw, n - n // 4) + _head(following, n // 4)


def _signed(texts: list[bytes], samples: int) -> np.ndarray:
    return signatures(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]), samples)


MID = ("edge boolean, part int, doc_id long, n_chars long, sha binary, sig binary, edited_sig binary, near_edited double, near_next double, "
       "first string, last string")
_MID = [c.split()[0] for c in MID.split(", ")]


def _compared(ids, texts: list[bytes], sigs: np.ndarray, samples: int) -> pa.RecordBatch:
    """Results of all texts but the last, each against its successor."""
    new = [_edited(t, u) for t, u in zip(texts[:-1], texts[1:])]
    own, after, edited = sigs[:-1], sigs[1:], _signed([e for _, e in new], samples)
    n = len(new)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.zeros(n, bool)), pa.nulls(n, pa.int32()), pa.array(ids[:-1], pa.int64()), pa.array([c for c, _ in new], pa.int64()),
         pa.array([hashlib.sha256(e).digest() for _, e in new], pa.binary()), _binary(own), _binary(edited),
         pa.array((own == edited).mean(axis=1)), pa.array((own == after).mean(axis=1)), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], names=_MID)


def compare_rows(samples: int):
    """Sorted texts of a partition: every row but the last against the next; first and last text go to the partition's edge row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, first, held = TaskContext.get().partitionId(), None, None
        for b, texts in _steps(batches):
            ids, raw = b.column(0).to_pylist(), pc.cast(texts, pa.binary()).to_pylist()
            sigs = _signed(raw, samples)
            if first is None:
                first = raw[0]
            else:
                ids, raw, sigs = [held[0], *ids], [held[1], *raw], np.concatenate([held[2], sigs])
            if len(raw) > 1:
                yield _compared(ids, raw, sigs, samples)
            held = ids[-1], raw[-1], sigs[-1:]
        if held is not None:
            null = pa.nulls(1)
            row = [pa.array([True]), pa.array([part], pa.int32()), pa.array([held[0]], pa.int64()), null.cast(pa.int64()),
                   *[null.cast(pa.binary())] * 3, *[null.cast(pa.float64())] * 2, pa.array([first.decode()]), pa.array([held[1].decode()])]
            yield pa.RecordBatch.from_arrays(row, names=_MID)
    return run


def edge_rows(samples: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, last, following in zip(*[c.to_pylist() for c in b.columns]):
                pair = [last.encode(), following.encode()]
                yield _compared([i, None], pair, _signed(pair, samples), samples)
    return run


def edited_likeness(docs: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text (the last quarter of its code points replaced by the first as
    many of the next document by id), and the likeness of its fingerprint to the edited text's and to the next document's.

    The texts move once, range-partitioned by id; a task compares neighbours as it streams, and leaves its first and last
    text in one edge row, so that the pairs over partition borders are compared after.
    """
    d = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).alias("text"))
    key = F.asc_nulls_first("doc_id")
    d = d.repartitionByRange(key).sortWithinPartitions(key, F.xxhash64("text").asc())
    mid = materialize(map_arrow(d, compare_rows(samples), MID), "fingerprints")
    edges = mid.filter("edge")
    # one row of two numbers per partition; the last partition's successor is the first
    order = Window.orderBy("part")
    nxt = edges.select("part", F.coalesce(F.lead("part").over(order), F.first("part").over(order)).alias("next_part"))
    pairs = edges.select("part", "doc_id", "last").join(nxt, "part") \
        .join(edges.select(F.col("part").alias("next_part"), F.col("first").alias("following")), "next_part")
    border = map_arrow(pairs.select("doc_id", "last", "following"), edge_rows(samples), MID)
    return mid.filter("not edge").unionByName(border).select(
        "doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), F.lower(F.hex("sig")).alias("fingerprint"),
        F.lower(F.hex("edited_sig")).alias("edited_fingerprint"), "near_edited", "near_next")

"""Cross-tokenizer alignment: which tokens of two public tokenizers end at the same byte of a text.

Inside a task everything is Arrow: the units of a batch (pieces of text both tokenizers always cut at) point into tables
of token lists, which are flattened with their parent indices; a segmented cumulative sum of token bytes gives each
token's end in its document; an Acero hash join on (document, end) finds the tokens that end together; and
``Table.group_by`` counts linked id pairs per task. Spark merges the partial counts, and a second pass over the written
links adds up each document's counts. Pairs above a count that at most ``hot_pairs`` pairs reach are looked up in a
broadcast of that bounded size; links of all other pairs are joined by a shuffle.

Byte tokens of A are the byte-level symbols decoded, of B the piece with U+2581 as space and ``<0xHH>`` as byte HH. A
encodes a space and the text, B adds that space itself; special tokens' strings in a text are plain text.

Defined results: texts that are null, empty or whose joined token bytes differ from space and text (such as those with
U+2581) have no tokens: zeros and the empty string. Rows that repeat an id or a text count each; an empty table gives no
rows; other columns, whatever their names, are not read. Very long texts are aligned whole; a step holds at least one text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.llm.common import arrow_batches, column, map_arrow, materialize
from casework.llm.tokens import byte_symbols

#: A unit starts at a space that follows a character which is no white space; neither tokenizer has a token over such a place.
_CUT = re.compile(r"(?<![\s᠎​])(?= )")
_RUN = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
#: Units of Latin-1 letters, digits, ASCII punctuation and single line ends inside: any engine of the pre-tokens' pattern
#: cuts them alike.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+(?:\n[!-~À-ÖØ-öø-ÿ]+)*").fullmatch
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Units remembered by a worker, and the longest remembered one.
UNITS, UNIT_CHARS = 300_000, 64
#: Units encoded in one call.
STEP_UNITS = 1024
#: Text bytes per step and partial counts held per task.
STEP_BYTES, HELD_PAIRS = 1 << 19, 1 << 18
#: Rows of links scored at once.
STEP_ROWS = 128
LINKS = "kind int, row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<{pair}>, counts array<long>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_level_tokens(tok) -> list[bytes]:
    back = {c: b for b, c in byte_symbols().items()}
    out = [b""] * tok.get_vocab_size()
    for piece, i in tok.get_vocab().items():
        out[i] = bytes(back[c] for c in piece) if all(c in back for c in piece) else piece.encode()
    return out


def piece_tokens(sp) -> list[bytes]:
    byte = re.compile(r"<0x([0-9A-F]{2})>").fullmatch
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    return [bytes([int(m[1], 16)]) if sp.is_byte(i) and (m := byte(p)) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]


class _Lists:
    """A growing table of integer lists, read as an Arrow list array."""

    def __init__(self):
        self.flat, self.ends = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int32)
        self.n = 0

    def extend(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        at, n = int(self.ends[self.n]), len(sizes)
        if at + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(at + len(flat), len(self.flat)), np.int32)])
        if self.n + n + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(len(self.ends) + n, np.int32)])
        self.flat[at:at + len(flat)] = flat
        self.ends[self.n + 1:self.n + 1 + n] = at + np.cumsum(sizes)
        self.n += n

    def array(self) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(self.ends[:self.n + 1]), pa.array(self.flat[:int(self.ends[self.n])]))


class Pair:
    """Both tokenizers, their tokens' bytes, and the units already encoded."""

    def __init__(self, path_a: str, path_b: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        pa.set_cpu_count(1)  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        import tiktoken
        # A's pairs merge in the order of their ids, so its own vocabulary gives the ranks of the faster library
        self.fast = tiktoken.Encoding("a", pat_str=_PATTERN, special_tokens={}, mergeable_ranks={
            t: i for i, t in enumerate(byte_level_tokens(self.a)) if i not in self.a.get_added_tokens_decoder()})
        self.space = [self.b.piece_to_id("▁")]
        self.bytes_a, self.bytes_b = byte_level_tokens(self.a), piece_tokens(self.b)
        self.len_a = pa.array(list(map(len, self.bytes_a)), pa.int32())
        self.len_b = pa.array(list(map(len, self.bytes_b)), pa.int32())
        self.size_a, self.size_b = self.len_a.to_numpy(), self.len_b.to_numpy()
        self.words_a = pa.array(list(map(str, range(len(self.bytes_a)))))
        self.words_b = pa.array(list(map(str, range(len(self.bytes_b)))))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.lists_a, self.lists_b, self.good = _Lists(), _Lists(), []

    def _one(self, unit: str) -> tuple[list[int], list[int], bool]:
        a = self.a.encode(" " + unit, add_special_tokens=False).ids
        b = self.b.encode(unit) or self.space  # B adds no space to an empty text
        raw = (" " + unit).encode()
        return a, b, b"".join([self.bytes_a[i] for i in a]) == raw == b"".join([self.bytes_b[i] for i in b])

    def _add(self, units: list[str], plain: bool) -> None:
        """Encode units (without their first space) at the end of the tables: as one text, which both tokenizers cut
        again at every unit, and one by one only where bytes do not come back or a unit ends in white space."""
        if plain or all(u and not u[-1].isspace() and u[-1] not in "\u180e\u200b" for u in units):
            text = " ".join(units)
            raw = (" " + text).encode()
            a = self.fast.encode_ordinary(" " + text) if plain else self.a.encode(" " + text, add_special_tokens=False).ids
            b = self.b.encode(text)
            if b"".join([self.bytes_a[i] for i in a]) == raw == b"".join([self.bytes_b[i] for i in b]):
                ends = np.cumsum(pc.binary_length(pa.array(units)).to_numpy().astype(np.int64) + 1)
                for ids, lengths, lists in ((a, self.size_a, self.lists_a), (b, self.size_b, self.lists_b)):
                    ids = np.fromiter(ids, np.int32, len(ids))
                    upto = np.searchsorted(np.cumsum(lengths[ids]), ends) + 1
                    lists.extend(ids, np.diff(upto, prepend=0))
                self.good += [True] * len(units)
                return
        if len(units) > 8:
            self._add(units[:len(units) // 2], plain)
            self._add(units[len(units) // 2:], plain)
            return
        for u in units:
            a, b, good = self._one(u)
            self.lists_a.extend(np.array(a, np.int32), np.array([len(a)]))
            self.lists_b.extend(np.array(b, np.int32), np.array([len(b)]))
            self.good.append(good)

    def _learn(self, units: list[str]) -> None:
        plain, other = [], []
        for u in units:
            (plain if _PLAIN(u) else other).append(u)
        for some, simple in ((plain, True), (other, False)):
            for i in range(0, len(some), STEP_UNITS):
                at, step = self.lists_a.n, some[i:i + STEP_UNITS]
                self._add(step, simple)
                self.known.update(zip(step, range(at, at + len(step))))

    def _units(self, texts: pa.Array) -> pa.ListArray:
        """The units of space + text without their first space, one list a text."""
        runs = pc.or_(pc.match_substring_regex(texts, _RUN), pc.starts_with(texts, " "))
        lists = pc.split_pattern(texts, " ")
        if not pc.any(runs).as_py():
            return lists
        cut = pa.array([[u[1:] for u in _CUT.split(" " + t) if u] for t in texts.filter(runs).to_pylist()], pa.list_(pa.string()))
        at = np.flatnonzero(runs.to_numpy(zero_copy_only=False))
        order = np.arange(len(texts))
        order[at] = len(texts) + np.arange(len(at))
        return pa.concat_arrays([lists, cut]).take(pa.array(order))

    def tokens(self, texts: pa.Array) -> tuple[pa.ListArray, pa.ListArray, np.ndarray, np.ndarray]:
        """Token lists per unit of all texts for A and B, the unit's text, and whether the unit's bytes come back."""
        if len(self.known) > UNITS:
            self.forget()
        lists = self._units(texts)
        coded = pc.list_flatten(lists).dictionary_encode()
        units = coded.dictionary.to_pylist()
        known = self.known
        at = list(map(known.get, units))
        kept, long = self.lists_a.n, []
        if None in at:
            new = [u for u, i in zip(units, at) if i is None]
            self._learn([u for u in new if len(u) <= UNIT_CHARS])
            kept = self.lists_a.n
            long = [u for u in new if len(u) > UNIT_CHARS]
            self._learn(long)
            at = list(map(known.get, units))
        pick = np.array(at, np.int32)[coded.indices.to_numpy()]
        a, b = (x.array().take(pa.array(pick)) for x in (self.lists_a, self.lists_b))
        good = np.array(self.good, bool)[pick]
        for u in long:  # not remembered
            del known[u]
        self.lists_a.n = self.lists_b.n = kept
        del self.good[kept:]
        return a, b, pc.list_parent_indices(lists).to_numpy(), good


@lru_cache(maxsize=1)
def pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def _ends(lists: pa.ListArray, doc_of_unit: pa.Array, lengths: pa.Array, n_docs: int):
    """Flattened ids, their documents, their byte ends in the document, and token counts per document."""
    ids = pc.list_flatten(lists)
    doc = pc.take(doc_of_unit, pc.list_parent_indices(lists))
    run = pc.cumulative_sum(pc.cast(pc.take(lengths, ids), pa.int64()))
    n = np.bincount(doc.to_numpy(), minlength=n_docs)
    last = np.cumsum(n)  # the running sum restarts at each document
    total = np.concatenate([[0], run.to_numpy()])
    base = pa.array(total[last - n])
    return ids, doc, pc.subtract(run, pc.take(base, doc)), n


def _keys(doc: pa.Array, end: pa.Array) -> pa.Array:
    return pc.bit_wise_or(pc.shift_left(pc.cast(doc, pa.int64()), 40), end)


def _joined(words: pa.Array, ids: pa.Array, ends: np.ndarray) -> pa.Array:
    """Decimal ids joined by commas, one string per run of ids ending at ``ends``."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), words.take(ids)), ",")


def align_texts(p: Pair, texts: pa.Array):
    """For each text: n_a, n_b, n_groups, digest of the groups; and all links as id pairs with their document."""
    n_docs = len(texts)
    lists_a, lists_b, doc_of, good = p.tokens(texts)
    bad = np.bincount(doc_of[~good], minlength=n_docs) > 0
    bad |= pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    if bad.any():
        keep = ~bad[doc_of]
        lists_a, lists_b, doc_of = lists_a.filter(pa.array(keep)), lists_b.filter(pa.array(keep)), doc_of[keep]
    units_doc = pa.array(doc_of)
    ids_a, doc_a, end_a, n_a = _ends(lists_a, units_doc, p.len_a, n_docs)
    ids_b, doc_b, end_b, n_b = _ends(lists_b, units_doc, p.len_b, n_docs)
    left = pa.table({"key": _keys(doc_a, end_a), "at_a": pa.array(np.arange(len(ids_a), dtype=np.int32))})
    right = pa.table({"key": _keys(doc_b, end_b), "at_b": pa.array(np.arange(len(ids_b), dtype=np.int32))})
    met = left.join(right, "key", join_type="inner", use_threads=False)
    partner = np.full(len(ids_a), -1, np.int32)  # the join's rows come in any order
    partner[met["at_a"].to_numpy()] = met["at_b"].to_numpy()
    at_a = np.flatnonzero(partner >= 0)
    at_b = partner[at_a]
    link_doc = doc_a.to_numpy()[at_a]
    n_groups = np.bincount(link_doc, minlength=n_docs)
    groups = pc.binary_join_element_wise(_joined(p.words_a, ids_a, at_a + 1), _joined(p.words_b, ids_b, at_b + 1), "|")
    ends = np.concatenate([[0], np.cumsum(n_groups)]).astype(np.int32)
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), groups), ";").to_pylist()
    digest = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in whole]
    pairs = ids_a.to_numpy()[at_a].astype(np.int64) * len(p.bytes_b) + ids_b.to_numpy()[at_b]
    return n_a, n_b, n_groups, digest, pairs, ends


def _steps(batches: Iterator[pa.RecordBatch]):
    """Rows in steps of about ``STEP_BYTES`` of text, at least one row each."""
    for b in batches:
        texts = pc.fill_null(pc.cast(b.column(1), pa.string()), "")
        step = (np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)) - 1) // STEP_BYTES
        ends = [*(np.flatnonzero(np.diff(step)) + 1).tolist(), len(texts)]
        for i, j in zip([0, *ends[:-1]], ends):
            if j > i:
                yield b.column(0).slice(i, j - i), texts.slice(i, j - i)


def _counted(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"])


def link_rows(path_a: str, path_b: str, small: bool):
    names = [c.split()[0] for c in LINKS.split(", ")]
    kind = np.int32 if small else np.int64

    def partial(held: pa.Table) -> pa.RecordBatch:
        one = pa.array([0, held.num_rows], pa.int32())
        null = pa.nulls(1, pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array([1], pa.int32()), null, null, null, null, null, pa.nulls(1, pa.string()),
             pa.ListArray.from_arrays(one, pa.array(held["pair"].to_numpy().astype(kind))), pa.ListArray.from_arrays(one, held["n"].combine_chunks())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        p, row, held = pair(path_a, path_b), TaskContext.get().partitionId() << 33, []
        for ids, texts in _steps(batches):
            n_a, n_b, n_groups, digest, pairs, ends = align_texts(p, texts)
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(n, np.int32)), pa.array(np.arange(row, row + n)), pc.cast(ids, pa.int64()), pa.array(n_a), pa.array(n_b),
                 pa.array(n_groups), pa.array(digest, pa.string()), pa.ListArray.from_arrays(pa.array(ends), pa.array(pairs.astype(kind))),
                 pa.nulls(n, pa.list_(pa.int64()))], names=names)
            row += n
            held.append(_counted([pa.table({"pair": pairs, "n": np.ones(len(pairs), np.int64)})]))
            if sum(t.num_rows for t in held) > HELD_PAIRS:
                held = [_counted(held)]
                if held[0].num_rows > HELD_PAIRS // 2:
                    yield partial(held.pop())
        if held:
            yield partial(_counted(held))
    return run


def pair_counts(links: DataFrame, n_ids_b: int) -> DataFrame:
    """Corpus-wide links of each id pair, and whether no pair of the same B id has more."""
    part = links.filter("kind = 1").select(F.explode(F.arrays_zip("links", "counts")).alias("x"))
    n = part.groupBy(F.col("x.links").cast("long").alias("pair")).agg(F.sum("x.counts").alias("n"))
    n = materialize(n, "align-pairs")
    most = n.groupBy((F.col("pair") % n_ids_b).alias("b")).agg(F.max("n").alias("most"))  # at most a vocabulary of rows
    return materialize(n.join(F.broadcast(most), F.col("pair") % n_ids_b == F.col("b"))
                       .select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "align-counts")


def _hot(counts: DataFrame, hot_pairs: int) -> tuple[DataFrame, bool]:
    """The pairs above a count that at most ``hot_pairs`` reach (all, where there are no more), and whether that is all."""
    if hot_pairs <= 0:
        return counts.limit(0), False
    step = F.floor(16 * F.log2(F.col("n").cast("double")))  # at most 16 * 64 steps
    seen = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("pairs")).orderBy(F.desc("step")).collect()
    taken, floor = 0, None
    for r in seen:
        if taken + r["pairs"] > hot_pairs:
            return counts.filter(step > r["step"]), False
        taken += r["pairs"]
    return counts, True


def score_rows(pairs, numbers, best):
    """Each row's sums over the links found in the broadcast, and the links that are not."""
    names = [c.split()[0] for c in SCORED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair.cache_clear()  # the worker may still hold the units of the pass before
        key, num, top = pairs.value, numbers.value, best.value
        for b in arrow_batches(batches, STEP_ROWS):
            links = b.column("links")
            flat, ends = links.values.to_numpy(zero_copy_only=False), links.offsets.to_numpy().astype(np.int64)
            flat, ends = flat[ends[0]:ends[-1]], ends - ends[0]
            at = np.minimum(np.searchsorted(key, flat), max(len(key) - 1, 0))
            hit = key[at] == flat if len(key) else np.zeros(len(flat), bool)
            add = np.where(hit, num[at], 0) if len(key) else np.zeros(len(flat), np.int64)
            good = hit & top[at] if len(key) else hit

            def sums(x):
                c = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
                return c[ends[1:]] - c[ends[:-1]]
            missed = np.concatenate([[0], np.cumsum(~hit)])[ends].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.diff(ends)), pa.array(sums(good)), pa.array(sums(add)),
                                              pa.ListArray.from_arrays(pa.array(missed), pa.array(flat[~hit].astype(np.int64)))], names=names)
    return run


SCORED = ("row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, "
          "n_best long, count_sum long, rest array<long>")


def alignment(docs: DataFrame, path_a: str, path_b: str, hot_pairs: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: tokens, groups, links, links whose pair is its B id's most frequent, the links' summed counts,
    and the digest of the groups. ``pair_links`` gives the links themselves."""
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    links = pair_links(docs, path_a, path_b, id_col, text_col)
    counts = pair_counts(links, _n_ids(path_b))
    hot, all_hot = _hot(counts, hot_pairs)
    got = hot.orderBy("pair").toArrow()
    parts = [sc.broadcast(got[c].to_numpy()) for c in ("pair", "n", "best")]
    rows = links.filter("kind = 0").select("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links")
    scored = map_arrow(rows, score_rows(*parts), SCORED)
    names = [c.split()[0] for c in RESULT.split(", ")]
    if all_hot:
        return scored.select(*names)
    scored = materialize(scored, "align-scored")
    rest = scored.select("row", F.explode("rest").alias("pair")).groupBy("row", "pair").agg(F.count(F.lit(1)).alias("k")) \
        .join(counts, "pair").groupBy("row").agg(F.sum(F.col("k") * F.col("n")).alias("more"),
                                                 F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("more_best"))
    return scored.drop("rest").join(rest, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"), "groups_sha256")


def _n_ids(path_b: str) -> int:
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()


def _n_ids_a(path_a: str) -> int:
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path_a).get_vocab_size()


def pair_links(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written table of links: rows of ``kind`` 0 hold a document's counts and its links in order (``links``: A id times
    the number of B ids plus B id); rows of ``kind`` 1 hold a task's partial counts of pairs."""
    d = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).alias("text"))
    small = _n_ids_a(path_a) * _n_ids(path_b) < 1 << 31  # then a pair is a 32-bit number
    return materialize(map_arrow(d, link_rows(path_a, path_b, small), LINKS.format(pair="int" if small else "long")), "align-links")

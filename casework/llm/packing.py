"""Best-fit packing of token pieces by length patterns.

Documents are encoded, cut into pieces of at most ``size`` tokens, and counted by length: a histogram of at most
``size`` numbers, whatever the corpus. On it, patterns of a few lengths that fill a sequence are enumerated over
length classes, their repeat counts are fitted to the histogram by non-negative least squares and rounded down,
and what remains (with the gaps the patterns leave) is packed best fit, longest first, again by counts. The
plan says for each length which ranges of its pieces go to which sequences at which offset; pieces are numbered
within their length by task and place, so tasks place their own pieces without gathering any length anywhere.

Defined results: null text counts as empty (one piece holding the end id); rows with the same id are separate
documents; an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casework.llm.common import arrow_batches, column, map_arrow, materialize, texts_of
from casework.llm.tokens import encoder

SIZE = 4096
END_ID = 1
#: Length classes of the pattern fit; lengths up to FILL are left to fill gaps.
CLASSES = 64
FILL = 256
STEP = 512
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def cut_pieces(path: str, spaced: bool, end_id: int, size: int):
    """Per document its pieces; ``nth`` numbers the pieces of a length within the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        enc, part = encoder(path, spaced), TaskContext.get().partitionId()
        end, seen = np.array([end_id], "<u4").tobytes(), np.zeros(size + 1, np.int64)
        for b in arrow_batches(batches, STEP):
            out = []
            for doc, t in zip(b.column("doc_id").to_pylist(), texts_of(b)):
                ids = enc.encode(t) + end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    piece = ids[at:at + 4 * size]
                    n = len(piece) // 4
                    out.append((doc, k, at // 4, n, zlib.crc32(piece), part, int(seen[n])))
                    seen[n] += 1
            names = [c.split()[0] for c in PIECES.split(", ")]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, types)], names=names)
    return run


def patterns(classes: int, width: int) -> list[tuple[int, ...]]:
    """Multisets of two or three classes (class c: lengths up to c * width) that fill a sequence of
    ``classes`` * width up to one class; and the full sequence alone."""
    out = [(classes,)]
    for a in range(1, classes):
        for b in range(1, a + 1):
            if classes - 1 <= a + b <= classes:
                out.append((a, b))
            for c in range(1, b + 1):
                if classes - 1 <= a + b + c <= classes:
                    out.append((a, b, c))
    return out


def non_negative_fit(a: np.ndarray, y: np.ndarray, rounds: int = 400) -> np.ndarray:
    """min |a x - y| over x >= 0 by an active set on the normal equations."""
    x, used = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        slope = a.T @ (y - a @ x)
        slope[used] = -np.inf
        j = int(slope.argmax())
        if slope[j] <= 1e-9 * max(1.0, float(np.abs(y).max(initial=0))):
            break
        used[j] = True
        while True:
            on = np.flatnonzero(used)
            s = np.linalg.lstsq(a[:, on], y, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[on] = s
                break
            bad = s <= 0
            step = np.min(x[on][bad] / np.maximum(x[on][bad] - s[bad], 1e-300))
            x[on] += step * (s - x[on])
            off = on[bad & (x[on] <= 1e-12)]
            used[off if len(off) else on[bad][:1]] = False
            x[~used] = 0
    return x


def plan(histogram: dict[int, int], size: int = SIZE, classes: int = CLASSES, fill: int = FILL) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths in order, how many), using up the histogram exactly."""
    left = np.zeros(size + 1, np.int64)
    for n, count in histogram.items():
        left[n] = count
    groups: list[tuple[int, tuple[int, ...], int]] = []  # free, lengths, how many
    width = size // classes
    kind = -(-np.arange(size + 1) // width)
    fits = patterns(classes, width)
    y = np.array([left[(kind == c) & (np.arange(size + 1) > fill)].sum() for c in range(classes + 1)], float)[1:]
    fits = [p for p in fits if all(y[c - 1] > 0 for c in p)]
    if fits and y.sum():
        a = np.zeros((classes, len(fits)))
        for j, p in enumerate(fits):
            for c in p:
                a[c - 1, j] += 1
        x = np.floor(non_negative_fit(a, y) + 1e-6).astype(np.int64)
        # all members but the last are the longest left of their class; the last is the longest piece, of
        # whatever class, that still fits: lengths inside a class make up for each other, so gaps are rare
        there = [n for n in range(fill + 1, size + 1) if left[n]]

        def take(n: int, k: int) -> None:
            left[n] -= k
            if not left[n]:
                there.pop(bisect_left(there, n))

        for j in sorted(np.flatnonzero(x), key=lambda j: -max(fits[j])):
            times = int(x[j])
            while times > 0:
                lengths: list[int] = []
                for c in fits[j]:
                    most = c * width if len(lengths) < len(fits[j]) - 1 else size - sum(lengths)
                    i = bisect_right(there, most) - 1
                    while i >= 0 and left[there[i]] <= lengths.count(there[i]):
                        i -= 1
                    if i < 0 or (len(lengths) < len(fits[j]) - 1 and there[i] <= (c - 1) * width):
                        break
                    lengths.append(there[i])
                if len(lengths) < len(fits[j]):
                    break  # a class is used up; its other pieces are residuals
                need = {n: lengths.count(n) for n in lengths}
                run = min([times, *(int(left[n]) // k for n, k in need.items())])
                for n, k in need.items():
                    take(n, k * run)
                groups.append((size - sum(lengths), tuple(lengths), run))
                times -= run
    # residuals: best fit by counts, longest first, into the gaps and then into new sequences
    by_free: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    frees: list[int] = []

    def put(free: int, lengths: tuple[int, ...], count: int) -> None:
        if not by_free[free]:
            insort(frees, free)
        by_free[free].append((lengths, count))

    for free, lengths, count in groups:
        put(free, lengths, count)
    for n in range(size, 0, -1):
        count = int(left[n])
        while count:
            i = bisect_left(frees, n)
            if i == len(frees):
                times = size // n
                if count >= times:
                    put(size - times * n, (n,) * times, count // times)
                    count %= times
                else:
                    put(size - count * n, (n,) * count, 1)
                    count = 0
                continue
            free = frees[i]
            lengths, have = by_free[free].pop()
            if not by_free[free]:
                frees.pop(i)
            # as many of this length as fit into one such sequence
            times = min(free // n, max(1, count // have))
            take = min(have, count // times)
            put(free - times * n, lengths + (n,) * times, take)
            if have > take:
                put(free, lengths, have - take)
            count -= times * take
    merged: dict[tuple[int, ...], int] = defaultdict(int)
    for entries in by_free.values():
        for lengths, count in entries:
            merged[lengths] += count
    return list(merged.items())


def slots(sequences: list[tuple[tuple[int, ...], int]], histogram: dict[int, int]) -> tuple[np.ndarray, ...]:
    """The plan as sorted runs of pieces: ``key`` (pieces of all shorter lengths, then the piece's number in its
    length), and for the run's first piece its sequence and offset."""
    base, total = {}, 0
    for n in sorted(histogram):
        base[n] = total
        total += histogram[n]
    key, seq, off, used, first = [], [], [], defaultdict(int), 0
    for lengths, count in sequences:
        at = 0
        for n in lengths:
            key.append(base[n] + used[n])
            seq.append(first)
            off.append(at)
            used[n] += count
            at += n
        first += count
    order = np.argsort(np.array(key, np.int64), kind="stable")
    return tuple(np.array(v, np.int64)[order] for v in (key, seq, off))


def place(key: np.ndarray, seq: np.ndarray, off: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, seqs, offs = key_b.value
        for b in batches:
            at = b.column("key").to_numpy()
            i = np.searchsorted(keys, at, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(seqs[i] + at - keys[i]), pa.array(offs[i])],
                                             names=[*b.schema.names[:-1], "sequence_id", "offset"])
    from pyspark import SparkContext
    key_b = SparkContext.getOrCreate().broadcast((key, seq, off))  # bounded by the plan: lengths and patterns, not documents
    return run


def packed(docs: DataFrame, tokenizer: str, spaced: bool = False, end_id: int = END_ID, size: int = SIZE,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    d = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).alias("text"))
    pieces = materialize(map_arrow(d, cut_pieces(tokenizer, spaced, end_id, size), PIECES), "pieces")
    by_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    # at most ``size`` rows
    histogram = {int(r[0]): int(r[1]) for r in by_part.groupBy("length").agg(F.sum("n")).collect()}
    base, total = [], 0
    for n in sorted(histogram):
        base.append((n, total))
        total += histogram[n]
    w = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select("part", "length", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    lengths = docs.sparkSession.createDataFrame(base, "length long, base long")
    key = (F.col("base") + F.col("before") + F.col("nth")).alias("key")
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    placed = pieces.join(before, ["part", "length"]).join(F.broadcast(lengths), "length").select(*cols, key)
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return map_arrow(placed, place(*slots(plan(histogram, size), histogram)), out)

"""Exact top-k inner products by norm-sorted blocks with rotated partial sums.

Components become integers floor(256 x). All vectors are rotated into the eigenvectors of their second-moment matrix
(the right singular vectors of the data), so that the first HEAD coordinates carry most of an inner product. Vectors are
range-partitioned and sorted by descending length. A task reads its vectors in blocks and keeps, per query, the k best
so far, starting from the scores against a few of the longest vectors. By Cauchy-Schwarz a query skips a block whose
longest vector cannot reach its k-th score; a task reads on, as the files it holds need not follow each other in length.
Else only the pairs whose head sum plus the product of the residual lengths reaches it are scored, exactly, in integers.
Pruning changes no result.

Queries never pass through the driver. A query's floor, a score that k others reach, comes from a broadcast of ``SEEDS`` longest
vectors, and the query is sent to those parts of the vectors only whose longest one can reach that floor. A task holds one part
(at most ``PART_ROWS`` vectors but for the last split of a hot length), and streams the queries sent to it in blocks.

Defined results: rows whose id is null, whose vector is null or holds a null or a non-finite component take no part;
every other row is a candidate of all queries with another id, also where ids repeat, and each row that the condition picks is a
query of its own; shorter vectors count as padded with zeros; ties go to the smaller id; an empty table gives an empty table; other
columns play no part. If the two longest vectors' lengths multiply to 2^63 or more, a ``ValueError`` says that scores would not fit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casework.llm.common import arrow_batches, column, map_arrow, materialize

HEAD = 16
BLOCK = 2048
SEEDS = 1024
PART_ROWS = 65536
EXACT = float(1 << 53)
#: Below every score, and safe to negate.
NONE = -np.iinfo(np.int64).max


def matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Integer vectors of a list column, padded with zeros to ``dim``."""
    flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    n = np.diff(ends)
    if len(n) and (n == dim).all():
        return flat[ends[0]:ends[-1]].reshape(-1, dim)
    out = np.zeros((len(n), dim), np.int64)
    for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
        out[i, :b - a] = flat[a:b]
    return out


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products; floating point serves where no sum can leave its exact range."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, q.shape[1]) < EXACT:
        return (q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
    return q @ v.T


def moments(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in arrow_batches(batches, BLOCK):
            v = matrix(b.column("v"), dim).astype(np.float64)
            total += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["row", "sums"])
    return run


def rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """Eigenvectors of the second-moment matrix, strongest first; dim rows of sums reach the driver."""
    parts = map_arrow(rows.select("v"), moments(dim), "row int, sums array<double>")
    sums = parts.select("row", F.posexplode("sums").alias("col", "x")).groupBy("row", "col").agg(F.sum("x").alias("x"))
    m = np.zeros((dim, dim))
    for r in sums.collect():
        m[r.row, r.col] = r.x
    return np.linalg.eigh(m)[1][:, ::-1]


class Best:
    """The k best (score, id) per query; equal scores go to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.score = np.full((queries, k), NONE)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.score[q], score]), np.concatenate([self.id[q], ids])
        top = np.lexsort((i, -s))[:self.score.shape[1]]
        self.score[q], self.id[q] = s[top], i[top]


def block_search(rot: np.ndarray, best: Best, ids: np.ndarray, queries: np.ndarray, low: np.ndarray, parts, head: int) -> None:
    """The k best of a part's vectors for a block of queries. ``parts``: (ids, vectors, rotated, residual lengths, longest) by block."""
    turned = queries @ rot
    length = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
    q_head, q_rest = turned[:, :head], np.sqrt((turned[:, head:] ** 2).sum(axis=1))
    order = np.argsort(-length, kind="stable")
    for vid, v, tv, v_rest, longest in parts:
        reach = np.maximum(low, best.score[:, -1])
        slack = 1e-9 * (1 + length * longest)
        live = order[(length * longest + slack >= reach)[order]]
        for at in range(0, len(live), 256):
            part = live[at:at + 256]
            bound = q_head[part] @ tv[:, :head].T
            bound += q_rest[part][:, None] * v_rest
            bound += slack[part][:, None]
            maybe = bound >= reach[part][:, None]
            if maybe.mean() > 0.05:  # dense: one exact product of the blocks
                exact = products(queries[part], v)
                maybe &= exact >= reach[part][:, None]
                for i in np.flatnonzero(maybe.any(axis=1)).tolist():
                    on = np.flatnonzero(maybe[i] & (vid != ids[part[i]]))
                    best.add(part[i], exact[i, on], vid[on])
            else:
                for i in np.flatnonzero(maybe.any(axis=1)).tolist():
                    on = np.flatnonzero(maybe[i] & (vid != ids[part[i]]))
                    best.add(part[i], products(queries[part[i]][None], v[on])[0], vid[on])


def search(rot: np.ndarray, k: int, head: int):
    """Rows of a part, its vectors ahead of the queries sent to it: the k best of the part for each query."""
    dim = len(rot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for b in arrow_batches(batches, BLOCK):
            numbers = b.column("part").to_numpy()
            is_query = b.column("query").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(is_query.astype(np.int8)) != 0)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(numbers)]):
                if i == j:
                    continue
                if part != numbers[i]:
                    part, held = numbers[i], []
                piece = b.slice(i, j - i)
                v, ids = matrix(piece.column("v"), dim), piece.column("id").to_numpy()
                if not is_query[i]:
                    tv = v @ rot
                    held.append((ids, v, tv, np.sqrt((tv[:, head:] ** 2).sum(axis=1)), float(piece.column("norm").to_numpy().max())))
                elif held:
                    best = Best(len(ids), k)
                    block_search(rot, best, ids, v, piece.column("floor").to_numpy(), held, head)
                    on = best.id != np.iinfo(np.int64).max
                    n = on.sum(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(piece.column("row").to_numpy(), n)), pa.array(np.repeat(ids, n)),
                                                      pa.array(best.id[on]), pa.array(best.score[on])], names=["row", "query_id", "vec_id", "score"])
    return run


def floors(long_id: np.ndarray, long_v: np.ndarray, k: int, parts: np.ndarray, longest: np.ndarray):
    """Queries with the k-th best of their scores against the longest vectors, once for each part that can reach it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_batches(batches, 256):
            q, ids, norm = matrix(b.column("v"), long_v.shape[1]), b.column("id").to_numpy(), b.column("norm").to_numpy()
            s = products(q, long_v)
            s[ids[:, None] == long_id[None, :]] = NONE
            floor = np.sort(s, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(ids), NONE)
            for i in range(0, len(parts), 4096):
                row, part = np.nonzero(norm[:, None] * longest[i:i + 4096] * (1 + 1e-9) + 1 >= floor[:, None])
                sent = b.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*sent.columns, pa.array(floor[row]), pa.array(parts[i + part])], names=[*b.schema.names, "floor", "part"])
    return run


def vectors(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v`` (integers) and length of the rows that take part."""
    x = column(embeddings, vector_col)
    rows = embeddings.select(column(embeddings, id_col).cast("long").alias("id"), x.cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("x").isNotNull()).filter(finite)
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, c: a + F.pow(F.floor(c * 256.0).cast("double"), 2.0)))
    return rows.select("id", F.transform("x", lambda c: F.floor(c * 256.0).cast("long")).alias("v"), norm.alias("norm"))


def top_k(embeddings: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5,
          head: int = HEAD, seeds: int = SEEDS, part_rows: int = PART_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the rows that ``queries`` (a condition on ``id``) picks, against all others."""
    spark = embeddings.sparkSession
    mid = F.monotonically_increasing_id()
    rows = vectors(embeddings, id_col, vector_col)
    order = [F.desc("norm"), F.asc("id"), F.asc("v")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # parts of a bounded number of rows; a row number that is written and so stays the same
    rows = materialize(rows.select("*", mid.alias("row"), F.concat_ws("-", F.spark_partition_id(), F.floor(
        mid.bitwiseAND(F.lit((1 << 33) - 1)) / part_rows)).alias("part_name")), "vectors")
    dim = rows.agg(F.max(F.size("v"))).first()[0]
    if dim is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    two = [r["norm"] for r in rows.orderBy(F.desc("norm")).limit(2).select("norm").collect()]
    if two[0] >= 2.0 ** 62 or two[0] * two[-1] >= 2.0 ** 63 * (1 - 1e-9) and len(two) > 1:
        raise ValueError("top_k: a vector is so long that scores leave the 64-bit range")
    dim, head = max(1, dim), min(head, max(1, dim))
    rot = rotation(rows, dim)
    rows = rows.withColumn("part", F.xxhash64("part_name")).drop("part_name")
    # the longest vectors, a bounded number, through a partial top
    top = rows.orderBy(*order).limit(seeds).select("id", "v").toArrow().combine_chunks()
    lists = top.column("v").combine_chunks()
    long_v = matrix(lists if isinstance(lists, pa.Array) else lists.chunk(0), dim) if top.num_rows else np.zeros((0, dim), np.int64)
    # a row of two numbers per part; a part is left out only where no vector of it can reach the query's floor
    parts = rows.groupBy("part").agg(F.max("norm").alias("longest")).toArrow()
    sent = map_arrow(rows.filter(queries).select("row", "id", "v", "norm"), floors(
        top.column("id").to_numpy(), long_v, k, parts["part"].to_numpy(), parts["longest"].to_numpy()),
        "row long, id long, v array<long>, norm double, floor long, part long")
    both = rows.select("part", F.lit(False).alias("query"), "row", "id", "v", "norm", F.lit(0).cast("long").alias("floor")) \
        .unionByName(sent.select("part", F.lit(True).alias("query"), "row", "id", "v", "norm", "floor"))
    both = both.repartition("part").sortWithinPartitions("part", "query", F.desc("norm"), "row")
    found = map_arrow(both, search(rot, k, head), "row long, query_id long, vec_id long, score long")
    w = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

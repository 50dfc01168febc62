"""Exact de-duplication with a heavy-hitter split.

A Misra-Gries summary per input partition finds the digests that may be frequent. The summaries are
merged by digest, and the ``counters`` largest are counted exactly: these verified groups form a table of
at most ``counters`` rows, which is broadcast, so that the copies of hot texts are decided without a
shuffle. All other digests take an ordinary shuffle; each of their groups holds at most about
``rows / counters`` rows.

Defined results: null text counts as empty; of equal texts the row with the largest ``doc_id`` stays (null
is smallest); of rows equal in text and ``doc_id`` exactly one stays; an empty table gives an empty table;
other columns, whatever their names, play no part beyond breaking ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casework.llm.common import column, map_arrow, materialize, packed_rows, row_hash

COUNTERS = 1024


def misra_gries(counts: dict[int, int], keys: np.ndarray, k: int) -> dict[int, int]:
    """Merge a batch of keys into a summary of at most ``k`` counters: batch counts are added, then the
    (k+1)-th largest count is taken from all. A key with more than n/(k+1) of n rows always remains."""
    for key, n in zip(*(x.tolist() for x in np.unique(keys, return_counts=True))):
        counts[key] = counts.get(key, 0) + n
    if len(counts) > k:
        cut = sorted(counts.values(), reverse=True)[k]
        counts = {key: n - cut for key, n in counts.items() if n > cut}
    return counts


def summaries(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        for b in batches:
            counts = misra_gries(counts, b.column(0).to_numpy(), k)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())],
                                         names=["h", "n"])
    return run


def digest(text: F.Column) -> F.Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per document: ``doc_id, digest, row_hash, keep_id, keep_hash, group_size, kept``."""
    rows = materialize(docs.select(column(docs, id_col).alias("doc_id"), digest(column(docs, text_col)).alias("digest"),
                                   row_hash(docs).alias("row_hash"), F.monotonically_increasing_id().alias("rid")), "digests")
    rows = rows.withColumn("h", F.xxhash64("digest"))
    # candidates: at most ``counters`` rows; a digest above rows/(counters+1) is in the summary of some partition
    hot = map_arrow(rows.select("h"), summaries(counters), "h long, n long") \
        .groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").orderBy(F.desc("n"), "h").limit(counters).select("h")
    best = F.max(F.struct("doc_id", "row_hash", "rid")).alias("best")
    size = F.count(F.lit(1)).alias("group_size")
    winners = rows.join(F.broadcast(hot), "h", "left_semi").groupBy("digest").agg(best, size).filter("group_size > 1")
    winners = materialize(winners, "winners")  # at most ``counters`` rows: the broadcasts below are bounded
    decided = rows.join(F.broadcast(winners), "digest")
    w = Window.partitionBy("digest")
    rest = rows.join(F.broadcast(winners), "digest", "left_anti") \
        .select("*", F.max(F.struct("doc_id", "row_hash", "rid")).over(w).alias("best"),
                F.count(F.lit(1)).over(w).alias("group_size"))
    cols = ["doc_id", "digest", "row_hash", F.col("best.doc_id").alias("keep_id"), F.col("best.row_hash").alias("keep_hash"),
            "group_size", (F.col("rid") == F.col("best.rid")).alias("kept")]
    return decided.select(*cols).unionAll(rest.select(*cols))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """``docs`` with one row of each group of equal texts; the columns stay as they are.

    Only the rows to drop (narrow: digest, id, row hash) meet the table again, in an anti join.
    """
    groups = materialize(copy_groups(docs, id_col, text_col, counters), "copy-groups")
    key = F.struct(F.col("digest"), F.col("doc_id"), F.col("row_hash")).alias("key")
    twin = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("row_hash") == F.col("keep_hash"))
    drop = groups.filter(~F.col("kept"))
    losers = drop.filter(~twin).select(F.hash("digest", "doc_id", "row_hash").alias("b"), key).distinct()
    keyed = packed_rows(docs, key=F.struct(digest(column(docs, text_col)).alias("digest"), column(docs, id_col).alias("doc_id"),
                                           row_hash(docs).alias("row_hash")))
    out = keyed.join(losers.select("key"), "key", "left_anti")
    twins = drop.filter(twin).select(key).distinct()
    if not twins.isEmpty():  # rows equal in every column: one of each is enough
        out = out.join(twins, "key", "left_anti").unionAll(
            out.join(twins, "key", "left_semi").groupBy("key").agg(F.first("_row").alias("_row")).select("_row", "key"))
    return out.select("_row.*")

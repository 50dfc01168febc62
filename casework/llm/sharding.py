"""Sharding by extendible hashing; DataFrame functions only.

A document's key is 60 bits of a hash of its id and text. A shard is a prefix of the key: the whole table is one
bucket of no bits, and only a bucket above the byte limit is split on its next bit, until all fit. The splits are
worked out on sums: documents are summed by a prefix a few bits longer than the limit asks for, and every such
leaf takes its shortest prefix that fits. Leaves that are still too large are summed again, they alone, by more bits.
The directory (one row per leaf) is then joined to the documents by the leaf.

A bucket whose rows all have the same key cannot be split by bits: a document above the limit is a shard of its
own, and copies of one row (same id and text) go to overflow pages, each within the limit, named by the task that
read them.

Defined results: null text has no bytes; a null id hashes as an empty one; an empty table gives an empty table;
other columns play no part in the split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casework.llm.common import column, materialize, packed_rows

LIMIT = 1 << 20
KEY_BITS = 60
#: Leaves are this many bits finer than equal shares of the limit would be.
FINER = 3


def shard_key(doc_id: Column, text: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"),
                                             F.coalesce(text, F.lit(""))).cast("binary")), 1, 15), 16, 10).cast("long")


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def prefix(key: Column, depth: int) -> Column:
    return F.shiftright(key, KEY_BITS - depth) if depth else F.lit(0).cast("long")


def bits(value: Column, depth: Column) -> Column:
    """A prefix as text; the bucket of no bits is the empty string."""
    return F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.bin(value), depth, "0"))


def directories(rows: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """``[(leaf depth, (leaf, depth, shard, shard_bytes, single))]`` for rows of ``key, bytes``. Later entries hold only
    the leaves that were too large in the one before."""
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    out, depth, open_rows = [], min(KEY_BITS, max(0, (-(-total // limit) - 1).bit_length()) + FINER), rows
    while True:
        leaves = open_rows.groupBy(prefix(F.col("key"), depth).alias("leaf")) \
            .agg(F.sum("bytes").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high"))
        leaves = materialize(leaves, "leaves")
        # every leaf's ancestors; where an earlier round split this leaf's parents, they do not fit and play no part
        ups = leaves.select("leaf", "bytes", "low", "high", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth")) \
            .withColumn("bucket", F.expr(f"shiftright(leaf, {depth} - depth)"))
        least = out[-1][0] if out else -1
        fit = ups.filter(F.col("depth") > least).groupBy("depth", "bucket") \
            .agg(F.sum("bytes").alias("shard_bytes"), (F.min("low") == F.max("high")).alias("single")) \
            .filter((F.col("shard_bytes") <= limit) | F.col("single"))
        found = ups.select("leaf", "depth", "bucket").join(fit, ["depth", "bucket"]) \
            .groupBy("leaf").agg(F.min(F.struct("depth", "bucket", "shard_bytes", "single")).alias("s")) \
            .select("leaf", "s.depth", bits(F.col("s.bucket"), F.col("s.depth")).alias("shard"), "s.shard_bytes", "s.single")
        found = materialize(found, "directory")
        out.append((depth, found))
        left = leaves.join(found, "leaf", "left_anti").select("leaf")
        if left.isEmpty():
            return out
        open_rows = materialize(open_rows.join(left, prefix(F.col("key"), depth) == F.col("leaf"), "left_semi"), "open-rows")
        depth = min(KEY_BITS, depth + FINER + 1)


def with_shards(rows: DataFrame, found: list[tuple[int, DataFrame]], limit: int) -> DataFrame:
    """``rows`` (with ``key, bytes, part``) and ``shard, depth, shard_bytes``."""
    done = None
    for depth, leaves in found:
        r = rows.join(leaves, prefix(F.col("key"), depth) == F.col("leaf")).drop("leaf")
        done = r if done is None else done.unionAll(r)
    crowded = F.col("single") & (F.col("shard_bytes") > limit)
    # a page holds as many of the equal rows of one reading task as fit
    w = Window.partitionBy("key", "part").orderBy("bytes")
    page = F.floor((F.row_number().over(w) - 1) / F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.lit(1), F.col("bytes")))))
    pages = done.filter(crowded).withColumn("page", F.concat_ws("-", F.col("shard"), F.col("part"), page))
    paged = pages.withColumn("shard", F.col("page")).withColumn("shard_bytes", F.sum("bytes").over(Window.partitionBy("page")))
    return done.filter(~crowded).drop("single").unionByName(paged.drop("single", "page"))


def sized(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return materialize(docs.select(column(docs, id_col).alias("doc_id"), text_bytes(column(docs, text_col)).alias("bytes"),
                                   shard_key(column(docs, id_col), column(docs, text_col)).alias("key"),
                                   F.spark_partition_id().alias("part")), "shard-sizes")


def shards(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, shard, depth, n_bytes, shard_bytes``."""
    rows = sized(docs, id_col, text_col)
    return with_shards(rows, directories(rows.select("key", "bytes"), limit), limit) \
        .select("doc_id", "shard", "depth", F.col("bytes").alias("n_bytes"), "shard_bytes")


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> str:
    """``docs`` as Parquet, one folder per shard (``shard=<bits>``; the whole table is ``shard=all``)."""
    rows = sized(docs, id_col, text_col)
    key = shard_key(column(docs, id_col), column(docs, text_col))
    keyed = packed_rows(docs, key=key, bytes=text_bytes(column(docs, text_col)), part=F.spark_partition_id())
    out = with_shards(keyed, directories(rows.select("key", "bytes"), limit), limit)
    name = F.when(F.col("shard") == "", "all").otherwise(F.concat(F.lit("b"), F.col("shard"))).alias("shard")
    out.select("_row.*", name).repartition("shard").write.partitionBy("shard").parquet(path)
    return path

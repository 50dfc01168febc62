"""Token ids in ORC files: integer run-length encoding, row indexes and Bloom filters on the document ids.

The texts are range-partitioned by ``doc_id`` and sorted, encoded where they lie, and written as one ORC file
per partition, so files and rows follow ascending ids. A reader takes stripes in parallel; row indexes and
Bloom filters let a look-up by id skip the stripes and row groups that cannot hold it.

Each row carries its file's number and the count of ids before it in that file, so a document's place in the
whole sequence follows from the sums per file (one row per file) without reading the ids.

Defined results: null text counts as empty (only the end id); null ids come first; rows with the same id are
ordered by a hash of the text; an empty table gives a folder without rows; other columns are not written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from casework.llm.common import arrow_batches, column, map_arrow, scratch_path, texts_of
from casework.llm.tokens import encoder

SCHEMA = "doc_id long, part int, ids_before long, n_tokens long, ids array<int>"
END_ID = 2
#: Rows per Python step: bounds a worker's memory.
STEP = 512


def _arrays(parts: list[bytes]) -> pa.ListArray:
    ends = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) // 4 for p in parts], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(parts), "<i4")))


def encode_rows(path: str, spaced: bool, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        enc, part, before = encoder(path, spaced), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for b in arrow_batches(batches, STEP):
            ids = [enc.encode(t) + end for t in texts_of(b)]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            at = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.full(len(ids), part, np.int32)), pa.array(at),
                                              pa.array(n), _arrays(ids)], names=["doc_id", "part", "ids_before", "n_tokens", "ids"])
    return run


def write_ids(docs: DataFrame, out: str, tokenizer: str, spaced: bool = True, end_id: int = END_ID, id_col: str = "doc_id",
              text_col: str = "text", stripe_bytes: int = 64 << 20, index_rows: int = 1000) -> str:
    """Encode ``docs`` with the file ``tokenizer`` and write the ids as ORC under ``out``."""
    d = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).alias("text"))
    key = F.asc_nulls_first("doc_id")  # the sampling of ranges reads no text; rows of one id stay together
    d = d.repartitionByRange(key).sortWithinPartitions(key, F.xxhash64("text").asc())
    ids = map_arrow(d, encode_rows(tokenizer, spaced, end_id), SCHEMA)
    ids.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", 0.01) \
        .option("orc.create.index", True).option("orc.row.index.stride", index_rows) \
        .option("orc.stripe.size", stripe_bytes).option("compression", "zstd").orc(out)
    return out


def _placed(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` with ``start``: the ids of all files before, and of the rows before in the own file."""
    files = rows.sparkSession.read.schema(T.StructType.fromDDL(SCHEMA)).orc(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    # one row of two numbers per written file, so the rows need not move
    return rows.join(F.broadcast(files), "part").withColumn("start", F.col("before") + F.col("ids_before")).drop("part", "before", "ids_before")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The written rows with ``start``, the number of ids in all rows before them."""
    rows = spark.read.schema(T.StructType.fromDDL(SCHEMA)).orc(path)
    return _placed(rows, path).select("doc_id", "start", "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, doc_ids: Sequence[int]) -> DataFrame:
    """The rows of a few documents: the filter reaches the ORC reader, whose statistics and Bloom filters skip the rest."""
    rows = spark.read.schema(T.StructType.fromDDL(SCHEMA)).orc(path)
    return rows.filter(F.col("doc_id").isin([int(i) for i in doc_ids]))


def crc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """CRC-32 of each row's ids as little-endian unsigned 32-bit integers, in place of the ids."""
    for b in batches:
        ids = b.column("ids")
        flat, ends = ids.values.to_numpy().astype("<i4", copy=False), ids.offsets.to_numpy().tolist()
        crc = [zlib.crc32(flat[i:j]) for i, j in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(crc, pa.int64())], names=[*b.schema.names[:-1], "ids_crc32"])


def id_digests(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(T.StructType.fromDDL(SCHEMA)).orc(path).select("doc_id", "part", "ids_before", "n_tokens", "ids")
    crc = map_arrow(rows, crc_rows, "doc_id long, part int, ids_before long, n_tokens long, ids_crc32 long")
    return _placed(crc, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the ids of ``docs`` into the shared folder and return the digests of what is read back."""
    spark = docs.sparkSession
    return id_digests(spark, write_ids(docs, scratch_path(spark, "ids-orc"), tokenizer))

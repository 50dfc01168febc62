"""Small helpers shared by the operators: reading tables, materialised tables, positions, row identity."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from casework.session import materialize, scratch_path, ship_package, shared_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(df: DataFrame, name: str) -> Column:
    """A column by its exact name, also where the name holds dots or back-ticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed_rows(df: DataFrame, **keys: Column) -> DataFrame:
    """``keys`` next to the whole row as one struct ``_row``, so that helper columns cannot clash with
    the table's own names; ``select("_row.*")`` brings the table back."""
    return df.select(F.struct(*[column(df, c) for c in df.columns]).alias("_row"),
                     *[v.alias(k) for k, v in keys.items()])


def row_hash(df: DataFrame) -> Column:
    """64-bit hash of all columns that can be hashed (maps cannot)."""
    cols = [column(df, f.name) for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.xxhash64(*cols)


def positions(df: DataFrame, *order: Column, name: str) -> DataFrame:
    """``df`` with ``position`` (from 0) in the given order, without bringing all rows into one task.

    The rows are range-partitioned and sorted, written once (so partitions are fixed), and each gets the
    number of rows in earlier partitions plus its place in its own; the offsets are one row per partition.
    """
    mid = F.monotonically_increasing_id()
    d = df.repartitionByRange(*order).sortWithinPartitions(*order)
    d = materialize(d.select("*", F.shiftright(mid, 33).cast("int").alias("_part"),
                             mid.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), name)
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    off = d.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")) \
        .select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    return d.join(off, "_part").select(*[column(df, c) for c in df.columns],
                                       (F.col("_before") + F.col("_at")).alias("position"))


def about(h: str, share: float) -> Column:
    """Whether a row's 64-bit hash ``h`` lies below ``share``: ahead of a small ordered sample, it bounds what the
    tasks send in together, however many they are."""
    return F.lit(True) if share >= 1 else F.shiftrightunsigned(F.col(h), 11).cast("double") / float(1 << 53) < share


def arrow_batches(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``: bounds what a task holds as Python objects."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with the package shipped to the Python workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> Sequence[str]:
    """A text column as Python strings; null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]

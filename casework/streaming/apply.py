"""Fitted feature stages on a stream.

The reference is batch-only. Every fitted stage's ``transform`` is a stateless ``select`` whose
fitted constants are literals, so the same fitted stages score new case files as they land:
``readStream`` over a folder → stateless transforms → the Parquet file sink (exactly once, by its log and the
checkpoint location). Stages that need whole-table order or fits (P4, W1,
P10's fit, encoders' fits) are not re-run on the stream.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def stream_cases(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet",
                 max_files_per_trigger: int = 16) -> DataFrame:
    """A streaming read of new case files in ``folder`` with a fixed schema."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        r = r.option("header", True)
    return r.format(fmt).load(folder)


def apply_stages(df: DataFrame, stages: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Chain fitted transforms (each a DataFrame → DataFrame projection)."""
    for s in stages:
        df = s(df)
    return df


def write_scored(df: DataFrame, out_path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write the stream through Spark's Parquet file sink, whose log of committed files makes a replayed
    micro-batch count once for every reader of ``out_path``."""
    w = df.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime="30 seconds")
    return w.start()

"""Readers for the parquet tables, the case files (S1-S3) and their row order."""

from __future__ import annotations

import os
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from casework.config import SCAN_MISSING
from casework.functions.text import col
from casework.sources.records import read_records

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


#: A single file above this size is read by splits.
SPLIT_BYTES = 64 << 20


def _size(spark: SparkSession, df: DataFrame) -> int:
    """Bytes of a scan's files, from the planner's listing."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def read_cases(spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType | None = None,
               infer_schema: bool = False, multiline: bool = True, row_id: str | None = "row_id", split: bool | None = None,
               split_bytes: int | None = None) -> DataFrame:
    """Read a case file (CSV with header, or parquet); a missing path gives an empty table.

    CSV is read as text unless ``schema`` is given (``infer_schema`` costs a full extra pass, so it
    is off by default: typing happens later from the values). Quoted fields may hold commas,
    doubled quotes and line breaks (``multiline``, on by default for correct parsing). ``split``: put records together from the
    splits of each file, in parallel (``sources.records``), rather than read every file in one task; by default so when there
    are several files or one exceeds ``SPLIT_BYTES``; ``split_bytes`` sets the size of the splits for this read (else the session's).
    Files that are not well-formed are read whole all the same.
    Cells holding one of the default missing tokens are NULL. ``row_id`` follows the order of file name and place in the file;
    pass ``row_id=None`` to skip it.
    """
    try:
        if fmt == "csv":
            reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multiline)
            if schema is not None:
                reader = reader.schema(schema)
            else:
                reader = reader.option("inferSchema", infer_schema)
            df = reader.csv(path)
        else:
            df = spark.read.format(fmt).load(path) if schema is None else spark.read.format(fmt).schema(schema).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return empty_frame(spark)
        raise
    if fmt != "csv" or not multiline:
        return numbered(df, row_id, fmt)
    if split is None:
        split = len(df.inputFiles()) > 1 or _size(spark, df) > SPLIT_BYTES
    rows = read_records(spark, path, df.schema, split_bytes=split_bytes) if split else None
    if rows is None:
        return numbered(missing_to_null(df), row_id, fmt)
    return missing_to_null(with_file_order(rows, row_id))


def with_file_order(rows: DataFrame, row_id: str | None, file: str = "_file", place: str = "_row") -> DataFrame:
    """``rows`` with ``row_id`` instead of their file and place in it: files by name, 2^40 ids each. A row per file is ordered in one task."""
    keep = [col(c) for c in rows.columns if c not in (file, place)]
    if not row_id:
        return rows.select(*keep)
    w = Window.orderBy(F.regexp_extract(file, "[^/]*$", 0), file)
    ranks = rows.select(file).distinct().select(file, (F.row_number().over(w) - 1).cast("long").alias("_rank"))
    return rows.join(F.broadcast(ranks), file).select(*keep, (F.col("_rank") * (1 << 40) + F.col(place)).alias(row_id))


def numbered(df: DataFrame, row_id: str | None, fmt: str) -> DataFrame:
    """``df`` with ids in scan order; of Parquet files a row's place in its file, after the files before it by name."""
    if not row_id:
        return df
    if fmt == "parquet" and df.inputFiles():
        return with_file_order(df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")), row_id)
    return df.withColumn(row_id, F.monotonically_increasing_id())


def missing_to_null(df: DataFrame, tokens: Sequence[str] = SCAN_MISSING) -> DataFrame:
    """Text cells that are one of the scan's missing tokens become NULL."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select(*[F.when(~col(c).isin(list(tokens)), col(c)).alias(c) if c in text else col(c) for c in df.columns])


def empty_frame(spark: SparkSession) -> DataFrame:
    """The empty table the builder returns early on."""
    return spark.createDataFrame([], T.StructType([]))


def is_empty(df: DataFrame) -> bool:
    return len(df.columns) == 0 or df.isEmpty()


def cohort_files(spark: SparkSession, folder: str) -> DataFrame:
    """A scan of every file under ``folder``, for its list of files."""
    return spark.read.option("recursiveFileLookup", True).text(folder)


def read_cohort_folder(spark: SparkSession, folder: str, fmt: str = "csv", **kw) -> DataFrame:
    """Every file under ``folder`` (recursively), with ``dataset`` = file name minus its last 4 characters and ``row_id`` in
    the order of file name and place in the file.

    One scan over all files; the builder then runs per dataset with a ``dataset = …`` filter. CSV records are put together
    from the files' splits (``sources.records``); files that are not well-formed are read one task each.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    if fmt == "csv":
        reader = reader.option("header", True).option("escape", '"').option("multiLine", kw.get("multiline", True)) \
            .option("inferSchema", kw.get("infer_schema", False))
    df = reader.format(fmt).load(folder)
    stem = F.expr("substring(_name, 1, length(_name) - 4)")
    rows = read_records(spark, folder, df.schema, recursive=True) if fmt == "csv" and kw.get("multiline", True) else None
    if rows is None:
        rows = df.select("*", F.col("_metadata.file_path").alias("_file"),
                         F.col("_metadata.row_index").alias("_row") if fmt == "parquet" else F.monotonically_increasing_id().alias("_row"))
        if fmt != "parquet":  # ids rise within a file, which one task reads
            first = rows.groupBy("_file").agg(F.min("_row").alias("_first"))
            rows = rows.join(F.broadcast(first), "_file").withColumn("_row", F.col("_row") - F.col("_first")).drop("_first")
    rows = rows.withColumn("_name", F.url_decode(F.replace(F.regexp_extract("_file", "[^/]*$", 0), F.lit("+"), F.lit("%2B"))))
    rows = with_file_order(rows.select(*[c for c in rows.columns if c != "_name"], stem.alias("dataset")), "row_id")
    return missing_to_null(rows) if fmt == "csv" else rows


def input_paths(df: DataFrame) -> list[str]:
    """The files of a scan as paths that a reader takes (Spark lists them as encoded URIs), in file-name order."""
    return sorted((unquote(p) for p in df.inputFiles()), key=lambda p: p.rsplit("/", 1)[-1])


def list_datasets(df: DataFrame) -> list[str]:
    """Dataset stems of a folder scan: of its rows, or of a file listing (``cohort_files``); bounded by the number of files."""
    if "dataset" in df.columns:
        return sorted(r["dataset"] for r in df.select("dataset").distinct().collect())
    return [n[:-4] for n in sorted({os.path.basename(p) for p in input_paths(df)})]

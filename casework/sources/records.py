"""Record assembly of CSV files with line breaks in quoted fields, in parallel over the splits of a file.

A line starts a record when the quotes before it in its file are even in number. Quotes are summed per split (one row each),
a prefix sum over the splits gives each split's parity at its start, and the tasks that read the splits then put lines
together where they lie. Only a record that crosses a split's border leaves its task: its pieces, at most two a split, meet
in the split where it began. Rows are numbered in the order of file name and place in the file.

The rule holds for well-formed files (a quote inside a field is doubled, and the field quoted). Records that are not send
the caller back to the reader that takes a file as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casework.operators.ordered import exclusive_scan
from casework.session import materialize, ship_package

#: A record of quoted and plain fields.
WELL_FORMED = r'''\A(?:"(?:[^"]++|"")*+"|[^",\r\n]*+)(?:,(?:"(?:[^"]++|"")*+"|[^",\r\n]*+))*+\r?\z'''
PIECES = "file string, block long, at long, head boolean, open boolean, record string"


@contextmanager
def split_size(spark: SparkSession, split_bytes: int | None):
    """The session's split size for a while."""
    conf = {} if split_bytes is None else {"spark.sql.files.maxPartitionBytes": str(split_bytes), "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def lines_of(spark: SparkSession, paths: str | list[str], recursive: bool = False) -> DataFrame:
    """(file, block, line) of text files in scan order; a line keeps all but its line feed."""
    t = spark.read.option("lineSep", "\n").option("recursiveFileLookup", recursive).text(paths)
    return t.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))


def assemble_lines(odd: dict) -> Callable:
    """Records of each split's lines. ``odd``: the splits that begin inside a quoted field."""
    names = [c.split()[0] for c in PIECES.split(", ")]

    def pieces(file: str, block: int, lines: pa.ChunkedArray) -> pa.RecordBatch:
        lines = pa.concat_arrays(lines.chunks)
        inside = (file, block) in odd
        before = np.concatenate([[int(inside)], pc.count_substring(lines, '"').to_numpy()]).cumsum()
        starts = np.flatnonzero(before[:-1] % 2 == 0)
        cuts = np.concatenate([starts, [len(lines)]])
        if not len(starts) or starts[0] > 0:
            cuts = np.concatenate([[0], cuts])  # the lines ahead of the first start belong to an earlier split's record
        n = len(cuts) - 1
        records = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), lines), "\n")
        head, open_ = np.zeros(n, bool), np.zeros(n, bool)
        head[0] = inside
        open_[-1] = before[-1] % 2 == 1
        return pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array(np.full(n, block)), pa.array(np.arange(n)), pa.array(head), pa.array(open_), records],
                                          names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for b in batches:
            where = list(zip(b.column("file").to_pylist(), b.column("block").to_pylist()))
            at = 0
            while at < len(where):
                end = at + 1
                while end < len(where) and where[end] == where[at]:
                    end += 1
                if where[at] != key:
                    if held:
                        yield pieces(*key, pa.chunked_array(held))
                    key, held = where[at], []
                held.append(b.column("line").slice(at, end - at))
                at = end
        if held:
            yield pieces(*key, pa.chunked_array(held))
    return run


def records_of(lines: DataFrame) -> DataFrame | None:
    """(file, row, record) of ``lines_of``: ``row`` counts a file's records from 0. None if a record is not well-formed."""
    spark = lines.sparkSession
    ship_package(spark)
    quotes = F.length("line") - F.length(F.replace(F.col("line"), F.lit('"'), F.lit("")))
    splits = materialize(lines.groupBy("file", "block").agg(F.sum(quotes).cast("long").alias("quotes")), "csv-splits")
    # a row per split, numbered along its file
    numbered = splits.select("file", "block", "quotes", (F.row_number().over(Window.partitionBy("file").orderBy("block")) - 1).cast("long").alias("_bucket"))
    most = (numbered.agg(F.max("_bucket")).first()[0] or 0) + 1
    before = exclusive_scan(numbered.select("file", "_bucket", "quotes"), ["file"], {"quotes": "sum"}, most)
    odd = numbered.drop("quotes").join(before, ["file", "_bucket"]).filter("quotes % 2 = 1").select("file", "block").collect()
    pieces = materialize(lines.mapInArrow(assemble_lines({(r["file"], r["block"]) for r in odd}), PIECES), "csv-pieces")
    # pieces of records over a border: an open end, then heads, up to the head that closes
    loose = pieces.filter("head OR open").select("file", "block", "at", "head", "record")
    own = Window.partitionBy("file").orderBy("block", "at")
    owned = loose.select("*", F.sum(F.when(F.col("head"), 0).otherwise(1)).over(own).alias("owner"))
    joined = owned.groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("block", "at", "record"))).alias("p")) \
        .select("file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["at"].alias("at"), F.array_join(F.col("p.record"), "\n").alias("record"))
    whole = materialize(pieces.filter("NOT head AND NOT open").select("file", "block", "at", "record").unionByName(joined), "csv-records")
    if whole.filter(~F.col("record").rlike(WELL_FORMED)).limit(1).count():
        return None
    counts = whole.filter("record NOT IN ('', '\\r')").groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    first = counts.select("file", "block", F.coalesce(F.sum("n").over(
        Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    place = Window.partitionBy("file", "block").orderBy("at")
    return whole.filter("record NOT IN ('', '\\r')").join(first, ["file", "block"]) \
        .select("file", (F.col("first") + F.row_number().over(place) - 1).alias("row"), F.regexp_replace("record", r"\r\z", "").alias("record"))


def read_records(spark: SparkSession, paths: str | list[str], schema: T.StructType, recursive: bool = False,
                 split_bytes: int | None = None) -> DataFrame | None:
    """The data rows of CSV files with a header record each, by ``schema``, with ``_file`` and ``_row`` (from 1)."""
    with split_size(spark, split_bytes):  # both passes over the lines run inside and so see the same splits
        records = records_of(lines_of(spark, paths, recursive))
    if records is None:
        return None
    options = {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    parsed = F.from_csv(F.col("record"), _ddl(schema), options)
    return records.filter("row > 0").select(parsed.alias("r"), F.col("file").alias("_file"), F.col("row").alias("_row")).select("r.*", "_file", "_row")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)

"""Order-dependent operators without a single-partition window (W1, M2 ranks, A11 running sums).

Two-level prefix: rows are cut into buckets along the order key — equal key ranges for dense
integer keys, written range partitions for keys of any other kind (dates, text, sparse numbers) —
so every bucket holds a bounded number of rows whatever the key distribution. Inside a bucket a
window partitioned by (group, bucket) does the local work; a summary of one row per
(group, bucket), built by partial aggregation, carries values across bucket borders through a
scan of the summary only, and is joined back on the same non-NULL key columns the window
used, so the rows are shuffled once. The scan of the summary has as many levels as it needs: windows over
blocks of at most ``FAN_IN`` buckets, one row per block above them, and so on, so no task reads more than
``FAN_IN`` rows of a summary either, however many buckets there are. With one bucket nothing is carried and nothing joined.
Groups that all fit a bucket are filled by a plain window per group. No step puts all rows of the table (or of one hot group)
in one task. The order key must be non-null and unique within a group for a deterministic result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casework.functions.text import col
from casework.session import materialize, shared_dir

# Default target rows per bucket; there may be any number of buckets.
ROWS_PER_BUCKET = 1 << 20
BUCKET = "_bucket"
#: Summary rows that one window of the carry may hold.
FAN_IN = 4096
_INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def add_order_buckets(df: DataFrame, order_by: str, rows_per_bucket: int = ROWS_PER_BUCKET,
                      min_buckets: int | None = None) -> DataFrame:
    """Add ``_bucket``: a non-decreasing function of ``order_by`` with bounded rows per bucket.

    One aggregation job gives count, min and max. An integral key that is dense (range at most
    4 × count) is cut into equal key ranges of ``width`` values, so no bucket holds more than
    ``width`` distinct keys. By any other key, of any type that sorts, the rows are range-partitioned
    and written once to the shared folder, so that a bucket is one partition and stays the same for
    every later reader; equal keys share a bucket.
    There are at least ``min_buckets`` buckets (default: the default parallelism) so the
    per-bucket windows, and everything downstream of them, use every core.
    """
    return _bucketed(df, order_by, rows_per_bucket, min_buckets)[0]


def _bucketed(df: DataFrame, order_by: str, rows_per_bucket: int, min_buckets: int | None = None) -> tuple[DataFrame, int]:
    """``add_order_buckets`` and an upper bound of the number of buckets."""
    key = col(order_by)
    dtype = dict(df.select(key.alias("k")).dtypes)["k"]
    st = df.agg(F.count(key).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    n = st["n"] or 0
    if min_buckets is None:
        min_buckets = df.sparkSession.sparkContext.defaultParallelism
    want = max(-(-n // rows_per_bucket), min(min_buckets, n // 64 + 1))
    if n == 0 or want <= 1:
        return df.withColumn(BUCKET, F.lit(0).cast("long")), 1
    if dtype in _INTEGRAL and (st["hi"] - st["lo"] + 1) <= 4 * n:
        span = st["hi"] - st["lo"] + 1
        width = max(1, min(-(-span // want), (rows_per_bucket * span) // n))
        return df.withColumn(BUCKET, F.floor((key - F.lit(st["lo"])) / F.lit(width)).cast("long")), -(-span // width)
    ranged = df.repartitionByRange(int(want), key).withColumn(BUCKET, F.spark_partition_id().cast("long"))
    return materialize(ranged, "order-buckets"), int(want)


def exclusive_scan(summary: DataFrame, gkeys: Sequence[str], kinds: dict[str, str], buckets: int, fan_in: int | None = None) -> DataFrame:
    """What lies before each bucket of its group: for a column of kind ``last`` the last non-NULL value, of kind ``sum`` the
    total. ``summary``: one row per (group, bucket), buckets numbered below ``buckets``. Windows hold at most ``fan_in`` rows
    of a group; a level above scans one row per block of that many buckets."""
    fan_in, block = fan_in or FAN_IN, "_block"

    def scans(w):
        return [(F.last(c, ignorenulls=True).over(w) if k == "last" else F.coalesce(F.sum(c).over(w), F.lit(0))).alias(c) for c, k in kinds.items()]

    def before(*keys):
        return Window.partitionBy(*(keys or [F.lit(0)])).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    if buckets <= fan_in:
        return summary.select(*gkeys, BUCKET, *scans(before(*gkeys)))
    s = summary.withColumn(block, F.floor(F.col(BUCKET) / fan_in).cast("long"))
    local = s.select(*gkeys, BUCKET, block, *scans(before(*gkeys, block)))
    tops = s.groupBy(*gkeys, block).agg(*[(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(BUCKET))) if k == "last" else F.sum(c)).alias(c)
                                          for c, k in kinds.items()])
    upper = exclusive_scan(tops.withColumnRenamed(block, BUCKET), gkeys, kinds, -(-buckets // fan_in), fan_in)
    upper = upper.select(*gkeys, F.col(BUCKET).alias(block), *[F.col(c).alias(f"_up{i}") for i, c in enumerate(kinds)])
    return local.join(upper, [*gkeys, block], "left").select(*gkeys, BUCKET, *[
        (F.coalesce(F.col(c), F.col(f"_up{i}")) if k == "last" else F.col(c) + F.coalesce(F.col(f"_up{i}"), F.lit(0))).alias(c)
        for i, (c, k) in enumerate(kinds.items())])


def _group_keys(b: DataFrame, parts: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Non-NULL key columns for (group, bucket): each group column becomes (value or a typed
    default, is-NULL flag). Windows, summaries and the carry join all use these same columns with
    plain equality, so the join needs no exchange on the (large) row side."""
    types = dict(b.dtypes)
    extra, keys = [], []
    for j, p in enumerate(parts):
        default = F.lit("") if types[p] == "string" else F.lit(0).cast(types[p])
        extra += [F.coalesce(col(p), default).alias(f"_pk{j}"), col(p).isNull().alias(f"_pn{j}")]
        keys += [f"_pk{j}", f"_pn{j}"]
    return (b.select("*", *extra) if extra else b), keys + [BUCKET]


def forward_fill(df: DataFrame, columns: Sequence[str], order_by: str, partition_by: Sequence[str] = (),
                 rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Replace NULLs by the last non-NULL value earlier in ``order_by`` order (within ``partition_by``).

    Leading NULLs stay NULL. Equivalent to
    ``last(c, ignorenulls) OVER (PARTITION BY p ORDER BY o ROWS UNBOUNDED PRECEDING)``.
    """
    columns = list(columns)
    if not columns:
        return df
    parts = list(partition_by)

    def filled(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        w = Window.partitionBy(*[col(k) for k in keys]).orderBy(col(order_by)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.select(*[col(c) for c in rows.columns if c not in columns], *[F.last(col(c), ignorenulls=True).over(w).alias(c) for c in columns])
    if parts and (df.groupBy(*[col(p) for p in parts]).count().agg(F.max("count")).first()[0] or 0) <= rows_per_bucket:
        return filled(df, parts).select(*[col(c) for c in df.columns])  # every group fits a task: one shuffle, nothing to carry
    bucketed, buckets = _bucketed(df, order_by, rows_per_bucket)
    b, keys = _group_keys(bucketed, parts)
    local = filled(b, keys)
    if buckets == 1:
        return local.select(*[col(c) for c in df.columns])
    # One row per (group, bucket): the bucket's last non-NULL value of each column. Aggregated
    # from the rows with a partial aggregate, so only one row per bucket per task is shuffled
    # (reading the window output instead would shuffle the rows a second time).
    summary = b.groupBy(*keys).agg(
        *[F.max_by(col(c), F.when(col(c).isNotNull(), col(order_by))).alias(f"_carry_{i}")
          for i, c in enumerate(columns)])
    carry = exclusive_scan(summary, keys[:-1], {f"_carry_{i}": "last" for i in range(len(columns))}, buckets)
    joined = local.join(carry, keys, "left")
    out_cols = []
    for c in df.columns:
        if c in columns:
            i = columns.index(c)
            out_cols.append(F.coalesce(col(c), F.col(f"_carry_{i}")).alias(c))
        else:
            out_cols.append(col(c))
    return joined.select(*out_cols)


def rank_within(df: DataFrame, order_by: str, partition_by: Sequence[str] = (), out: str = "rank",
                rows_per_bucket: int = ROWS_PER_BUCKET, tiebreak: Sequence[str] = ()) -> DataFrame:
    """0-based row number in (``order_by``, ``tiebreak``...) order within ``partition_by`` groups.

    Buckets follow ``order_by`` only; ties on it share a bucket, where ``tiebreak`` orders them."""
    bucketed, buckets = _bucketed(df, order_by, rows_per_bucket)
    b, keys = _group_keys(bucketed, list(partition_by))
    w_local = Window.partitionBy(*[col(k) for k in keys]).orderBy(col(order_by), *[col(t) for t in tiebreak])
    local = b.withColumn("_local", F.row_number().over(w_local) - 1)
    if buckets == 1:
        return local.select(*[col(c) for c in df.columns], F.col("_local").cast("long").alias(out))
    counts = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("_offset"))
    j = local.join(exclusive_scan(counts, keys[:-1], {"_offset": "sum"}, buckets), keys, "left")
    return j.select(*[col(c) for c in df.columns], (F.col("_local") + F.col("_offset")).alias(out))


def running_sums(df: DataFrame, order_by: str, value_cols: Sequence[str], partition_by: Sequence[str] = (),
                 exclusive: bool = False, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Running sums of ``value_cols`` in ``order_by`` order (``exclusive``: rows strictly before)."""
    vals = list(value_cols)
    bucketed, buckets = _bucketed(df, order_by, rows_per_bucket)
    b, keys = _group_keys(bucketed, list(partition_by))
    end = -1 if exclusive else Window.currentRow
    w_local = Window.partitionBy(*[col(k) for k in keys]).orderBy(col(order_by)) \
        .rowsBetween(Window.unboundedPreceding, end)
    local = b.select("*", *[F.coalesce(F.sum(col(v)).over(w_local), F.lit(0)).alias(f"_loc_{i}")
                            for i, v in enumerate(vals)])
    if buckets == 1:
        return local.select(*[col(c) for c in df.columns], *[F.col(f"_loc_{i}").alias(f"cum_{v}") for i, v in enumerate(vals)])
    totals = b.groupBy(*keys).agg(*[F.sum(col(v)).alias(f"_off_{i}") for i, v in enumerate(vals)])
    j = local.join(exclusive_scan(totals, keys[:-1], {f"_off_{i}": "sum" for i in range(len(vals))}, buckets), keys, "left")
    return j.select(*[col(c) for c in df.columns],
                    *[(F.col(f"_loc_{i}") + F.col(f"_off_{i}")).alias(f"cum_{v}") for i, v in enumerate(vals)])


def dense_codes(df: DataFrame, column: str, out: str = "code") -> DataFrame:
    """0-based rank of each distinct non-NULL value of ``column`` in sorted (code point) order.

    Works for any type and any number of distinct values: the distinct values are range
    partitioned and sorted, materialised with ``checkpoint()`` (so partition order is fixed
    across retries), then each partition's local position plus the row count of all earlier
    partitions (a table with one row per partition) gives the rank.
    """
    shared_dir(df.sparkSession)
    d = df.select(col(column).alias("value")).filter(F.col("value").isNotNull()).distinct() \
        .orderBy("value").checkpoint()
    d = d.select("value", F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().alias("_mid"))
    d = d.select("value", "_pid", (F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)).alias("_local"))
    counts = d.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    # One row per partition: a proven bound, so the broadcast is safe.
    return d.join(F.broadcast(offsets), "_pid").select(F.col("value").alias(column),
                                                      (F.col("_off") + F.col("_local")).alias(out))


def in_one_partition(df: DataFrame, order_by: str) -> DataFrame:
    """The rows as one partition in ``order_by`` order, for a writer of a single file. They are sorted in range partitions and
    checkpointed; the one task then streams these one after the other and holds none of them. (Of a checkpoint either all
    partitions have preferred hosts or none, so that joining them keeps their order.)"""
    shared_dir(df.sparkSession)
    return df.orderBy(col(order_by)).checkpoint().coalesce(1)

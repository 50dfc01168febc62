"""Inputs derived from the driver's tables: the wide case table and a messy-token view.

Each definition exists twice: as DataFrame code (what the library runs) and as SQL
text for the DuckDB oracle. The driver's tables hold no NULLs, so missing values
and sentinels are derived from the key by modulus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casework.sources.tables import table

# Line order inside an order that defines the drug slots ((l_orderkey, l_linenumber) is not unique).
SLOT_ORDER = ("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate")
N_SLOTS = 3


def build_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The case table: one row per order with at least one line.

    Plan shape: lineitem is aggregated per order (partial aggregation before the shuffle, so a
    hot order costs one row per map task), slots come from a top-3 row_number filter (Catalyst
    adds a partial WindowGroupLimit before the shuffle), and both sides stay hash-partitioned
    by order key, so the join with orders adds no exchange on that side.
    """
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", "p_retailprice")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus",
                                                   "o_orderdate", "o_orderpriority")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")

    per_order = li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("tothlos"),
        F.sum("l_quantity").alias("optime"),
        F.avg("l_discount").alias("_avg_disc"),
    )
    w = Window.partitionBy("l_orderkey").orderBy(*SLOT_ORDER)
    slots = (li.select("l_orderkey", *SLOT_ORDER)
             .withColumn("_slot", F.row_number().over(w))
             .filter(F.col("_slot") <= N_SLOTS)
             .join(part, F.col("l_partkey") == F.col("p_partkey"), "left"))
    slot_cols = []
    for i in range(1, N_SLOTS + 1):
        slot_cols.append(F.max(F.when(F.col("_slot") == i, F.col("p_type"))).alias(f"_type{i}"))
    slot_cols.append(F.max(F.when(F.col("_slot") == 1, F.col("p_size"))).alias("_size1"))
    slot_cols.append(F.max(F.when(F.col("_slot") == 1, F.col("p_retailprice"))).alias("_price1"))
    slot_wide = slots.groupBy(F.col("l_orderkey").alias("s_orderkey")).agg(*slot_cols)

    k = F.col("o_orderkey")
    joined = (orders.join(per_order, k == F.col("l_orderkey"))
              .join(slot_wide, k == F.col("s_orderkey"))
              .join(cust, F.col("o_custkey") == F.col("c_custkey"), "left"))
    return joined.select(
        k.alias("caseid"),
        F.col("tothlos"),
        F.col("optime"),
        F.when(k % 11 == 0, F.lit(None).cast("double")).otherwise(F.round("_avg_disc", 6)).alias("pralbum"),
        F.when(k % 17 == 0, F.lit("-99")).when(k % 19 == 0, F.lit("tall"))
         .otherwise((F.lit(30) + F.col("_size1")).cast("string")).alias("height"),
        F.when(k % 13 == 0, F.lit(" NULL ")).otherwise(F.floor(F.col("_price1") / 10).cast("string")).alias("weight"),
        F.when(F.col("o_orderstatus") == "F", F.lit(" Yes")).when(F.col("o_orderstatus") == "O", F.lit("no"))
         .when(F.col("o_orderstatus") == "P", F.lit("-99")).alias("transfus"),
        F.when(k % 7 == 0, F.lit("Superficial SSI")).when(k % 5 == 0, F.lit("No Complication")).alias("dsupinfec"),
        F.when(k % 23 == 0, F.lit("Organ/Space SSI")).otherwise(F.lit("null")).alias("orgspcssi"),
        F.col("o_orderpriority").alias("asaclas"),
        F.col("c_mktsegment").alias("race"),
        F.col("_type1").alias("ped_sap_name1"),
        F.col("_type2").alias("ped_sap_name2"),
        F.when(k % 3 == 0, F.lit("  ")).otherwise(F.col("_type3")).alias("ped_sap_name3"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("date_of_surgery"),
        F.lit(1).alias("htooday"),
    )


CASES_SQL = """
WITH li AS (
  SELECT l_orderkey, l_partkey,
         row_number() OVER (PARTITION BY l_orderkey
                            ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_shipdate) AS slot
  FROM lineitem
), per_order AS (
  SELECT l_orderkey, count(*) AS tothlos, sum(l_quantity) AS optime, avg(l_discount) AS avg_disc
  FROM lineitem GROUP BY l_orderkey
), slots AS (
  SELECT li.l_orderkey,
         max(CASE WHEN slot = 1 THEN p_type END) AS type1,
         max(CASE WHEN slot = 2 THEN p_type END) AS type2,
         max(CASE WHEN slot = 3 THEN p_type END) AS type3,
         max(CASE WHEN slot = 1 THEN p_size END) AS size1,
         max(CASE WHEN slot = 1 THEN p_retailprice END) AS price1
  FROM li LEFT JOIN part ON li.l_partkey = part.p_partkey
  WHERE slot <= 3
  GROUP BY li.l_orderkey
)
SELECT o_orderkey AS caseid,
       CAST(tothlos AS BIGINT) AS tothlos,
       optime,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE round(avg_disc, 6) END AS pralbum,
       CASE WHEN o_orderkey % 17 = 0 THEN '-99' WHEN o_orderkey % 19 = 0 THEN 'tall'
            ELSE CAST(30 + size1 AS VARCHAR) END AS height,
       CASE WHEN o_orderkey % 13 = 0 THEN ' NULL ' ELSE CAST(CAST(floor(price1 / 10) AS BIGINT) AS VARCHAR) END AS weight,
       CASE o_orderstatus WHEN 'F' THEN ' Yes' WHEN 'O' THEN 'no' WHEN 'P' THEN '-99' END AS transfus,
       CASE WHEN o_orderkey % 7 = 0 THEN 'Superficial SSI' WHEN o_orderkey % 5 = 0 THEN 'No Complication' END AS dsupinfec,
       CASE WHEN o_orderkey % 23 = 0 THEN 'Organ/Space SSI' ELSE 'null' END AS orgspcssi,
       o_orderpriority AS asaclas,
       c_mktsegment AS race,
       type1 AS ped_sap_name1,
       type2 AS ped_sap_name2,
       CASE WHEN o_orderkey % 3 = 0 THEN '  ' ELSE type3 END AS ped_sap_name3,
       CAST(o_orderdate AS TIMESTAMP) AS date_of_surgery,
       CAST(1 AS INTEGER) AS htooday
FROM orders
JOIN per_order ON o_orderkey = per_order.l_orderkey
JOIN slots ON o_orderkey = slots.l_orderkey
LEFT JOIN customer ON o_custkey = c_custkey
"""


def cases_cte(body: str) -> str:
    """Wrap an oracle query so it can read ``cases``."""
    return f"WITH cases AS ({CASES_SQL})\n{body}"


def build_messy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text columns with missing-value tokens and bad dates, derived from events."""
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "user_id")
    k = F.col("event_id")
    r = k % 10
    status = (F.when(r == 0, F.lit("-99")).when(r == 1, F.lit("-99.0")).when(r == 2, F.lit(" Null "))
              .when(r == 3, F.lit("#NULL!")).when(r == 4, F.lit("N/A")).when(r == 5, F.lit(""))
              .when(r == 6, F.lit("ok ")).when(r == 7, F.lit(" na")).otherwise(F.col("event_type")))
    amount = (F.when(k % 6 == 0, F.lit("NULL")).when(k % 6 == 1, F.lit("n/a"))
              .otherwise(F.concat(F.lit(" "), (F.col("user_id") % 97).cast("string"), F.lit(" "))))
    day = (F.when(k % 8 == 0, F.lit("bad")).when(k % 8 == 1, F.lit(None).cast("string"))
           .when(k % 8 == 2, F.date_format(F.col("ts"), "yyyy-MM-dd HH:mm:ss"))
           .otherwise(F.date_format(F.col("ts"), "yyyy-MM-dd")))
    return ev.select(k, status.alias("status"), amount.alias("amount_text"), day.alias("day_text"))


MESSY_EVENTS_SQL = """
SELECT event_id,
       CASE event_id % 10 WHEN 0 THEN '-99' WHEN 1 THEN '-99.0' WHEN 2 THEN ' Null ' WHEN 3 THEN '#NULL!'
            WHEN 4 THEN 'N/A' WHEN 5 THEN '' WHEN 6 THEN 'ok ' WHEN 7 THEN ' na' ELSE event_type END AS status,
       CASE WHEN event_id % 6 = 0 THEN 'NULL' WHEN event_id % 6 = 1 THEN 'n/a'
            ELSE ' ' || CAST(user_id % 97 AS VARCHAR) || ' ' END AS amount_text,
       CASE WHEN event_id % 8 = 0 THEN 'bad' WHEN event_id % 8 = 1 THEN NULL
            WHEN event_id % 8 = 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
            ELSE strftime(ts, '%Y-%m-%d') END AS day_text
FROM events
"""


def messy_cte(body: str) -> str:
    return f"WITH messy_events AS ({MESSY_EVENTS_SQL})\n{body}"

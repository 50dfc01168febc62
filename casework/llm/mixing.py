"""Mixing sources to target weights by capped water-filling; DataFrame functions only.

Sources share a budget (``share`` times all words) by weight; none gets more than ``epochs`` times its own
words, and what a clamped source cannot take goes to the others by weight, round by round, until no target
is above its cap. A source is then taken in whole passes and one fractional pass: the documents whose
seeded hash lies below a cut, found without sorting the source: hash buckets of about sqrt(documents)
rows are summed, the bucket that holds the cut is found from the sums, and only its rows are sorted.

Defined results: null text has size 0; null is a source of its own, the last; a null ``doc_id`` hashes as
an empty one; rows equal in id and text are interchangeable; sources without words get target 0; an empty
table gives an empty table; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casework.llm.common import column, materialize, packed_rows, positions

WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"


def words(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(seed: int, doc_id: F.Column, text: F.Column) -> F.Column:
    """52 bits that depend on the seed, the id and the text only."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"),
                                             F.coalesce(text, F.lit(""))).cast("binary")), 1, 13), 16, 10).cast("long")


def water_fill(sources: DataFrame, share: float, epochs: float) -> DataFrame:
    """``sources`` (weight, source_size) with ``target``. Only sums of the rounds reach the driver."""
    cap = epochs * F.col("source_size")
    total, weight, n = sources.agg(F.sum("source_size"), F.sum("weight"), F.count(F.lit(1))).first()
    left, open_weight, clamped = share * float(total or 0), float(weight or 0), -1
    while open_weight > 0:
        full = cap * open_weight <= F.lit(left) * F.col("weight")
        kept, freed, now = sources.agg(F.sum(F.when(~full, F.col("weight"))), F.sum(F.when(full, cap)),
                                       F.count_if(full)).first()
        if now == clamped:
            break
        left, open_weight, clamped = share * float(total or 0) - (freed or 0.0), float(kept or 0), now
    if open_weight == 0:
        return sources.withColumn("target", cap)
    full = cap * open_weight <= F.lit(left) * F.col("weight")
    return sources.withColumn("target", F.when(full, cap).otherwise(F.lit(left) * F.col("weight") / F.lit(open_weight)))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
            weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, epochs: float = 2.0, seed: int = 17,
            whole_documents: bool = False) -> DataFrame:
    """One row per document: ``doc_id, source, u, size, source_size, target, taken``.

    ``u`` is the seeded hash. ``taken`` is 0, 1 or more whole passes over the document's words; the one
    document per source in which the fractional pass ends gives just the words that are still missing, or,
    with ``whole_documents``, all or none of them, whichever comes nearer.
    """
    d = docs.select(column(docs, id_col).alias("doc_id"), column(docs, source_col).alias("source"),
                    words(column(docs, text_col)).alias("size"),
                    seeded(seed, column(docs, id_col), column(docs, text_col)).alias("u"))
    d = materialize(d, "mix-sizes")
    by_source = d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    s = positions(by_source, F.asc_nulls_last("source"), name="mix-sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    s = materialize(s.withColumn("weight", weight), "mix-weights")
    s = water_fill(s, share, epochs)
    goal, passes = F.round("target").cast("long"), F.floor(F.col("target") / F.col("source_size"))
    s = s.withColumn("passes", F.when(F.col("source_size") > 0, passes).otherwise(0)) \
        .withColumn("rest", goal - F.col("passes") * F.col("source_size")) \
        .withColumn("buckets", F.ceil(F.sqrt(F.col("n"))))
    # source tables are one row per source; the planner broadcasts them while they are small
    same = d["source"].eqNullSafe(s["source"])
    bucket = F.floor(F.col("u") / F.lit(float(1 << 52)) * F.col("buckets")).cast("long")
    d = d.join(s, same).select(d["*"], "position", "source_size", "target", "passes", "rest", bucket.alias("bucket"))
    sums = d.groupBy("position", "bucket", "rest").agg(F.sum("size").alias("words"))
    w = Window.partitionBy("position").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(w), F.lit(0)))
    cut = sums.filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest"))) \
        .select("position", F.col("bucket").alias("cut"), "before")
    base = F.col("passes") * F.col("size")
    cols = ["doc_id", "source", "u", "size", "source_size", "target"]
    # without a cut the fractional pass is empty; the cut is at most one row per source
    far = d.join(cut.select("position", "cut"), "position", "left").filter(~F.col("bucket").eqNullSafe(F.col("cut"))) \
        .select(*cols, (base + F.when(F.col("bucket") < F.col("cut"), F.col("size")).otherwise(0)).cast("long").alias("taken"))
    # joined by source and bucket, so that a hot source is dealt out before its one bucket is sorted
    here = d.join(cut.select("position", F.col("cut").alias("bucket"), "before"), ["position", "bucket"])
    w = Window.partitionBy("position").orderBy("u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    near = here.withColumn("missing", F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(w), F.lit(0)))
    extra = F.when(F.col("missing") <= 0, 0).when(F.col("missing") >= F.col("size"), F.col("size"))
    extra = extra.otherwise(F.when(2 * F.col("missing") >= F.col("size"), F.col("size")).otherwise(0)
                            if whole_documents else F.col("missing"))
    return far.unionAll(near.select(*cols, (base + extra).cast("long").alias("taken")))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17,
          **kw) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as its whole passes; columns stay as they are."""
    m = mixture(docs, id_col, text_col, source_col, seed=seed, whole_documents=True, **kw)
    m = m.select("u", "doc_id", "source", F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int").alias("times")) \
        .groupBy("u", "doc_id", "source").agg(F.sum("times").alias("times"), F.count(F.lit(1)).alias("rows")).filter("times > 0")
    m = materialize(m, "mix-times")
    keyed = packed_rows(docs, u=seeded(seed, column(docs, id_col), column(docs, text_col)),
                        doc_id=column(docs, id_col), source=column(docs, source_col))
    same = (keyed["u"] == m["u"]) & keyed["doc_id"].eqNullSafe(m["doc_id"]) & keyed["source"].eqNullSafe(m["source"])
    # rows equal in id, text and source share their passes: each gets the rounded mean
    return keyed.join(m, same).select("_row", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.round(
        F.col("times") / F.col("rows"))).cast("int"))).alias("_time")).select("_row.*")

"""Quality selection by importance resampling.

Two bag-of-n-gram models over BUCKETS hashed word unigrams and bigrams: the raw model counts every document,
the target model the documents labelled as good. A document's log weight is the sum over its n-grams of the
log ratio of both models. With a seeded Gumbel draw added, the k largest keys are a sample without
replacement in proportion to the weights; k is the number of documents times the share of good labels.

The target model is fitted on at most ``target_rows`` good documents (smallest seeded hash of the id); the raw
counts, the weights and the selection cover all rows. Keys are ranked by range partitions, not in one task.

Defined results: null or blank text has no n-grams and log weight 0; a null id carries no label; an id labelled
twice is good if any of its labels is; repeated rows weigh alike, and draw alike if id and text are equal; without
labels all rows are kept; an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.llm.common import about, arrow_batches, column, map_arrow, materialize, positions, texts_of
from casework.llm.near_dedup import document_words, mix

BUCKETS = 10_000
STEP = 256
_PAIR = np.uint64(0xD6E8FEB86659FD93)


def n_grams(words: np.ndarray) -> np.ndarray:
    """Buckets of the unigrams and bigrams of a word sequence."""
    pairs = mix(words[:-1] * _PAIR + words[1:])
    return (np.concatenate([words, pairs]) % np.uint64(BUCKETS)).astype(np.int64)


def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per bucket and task: n-grams of all rows, and of the target rows."""
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for b in arrow_batches(batches, STEP):
        good = b.column("good").to_numpy(zero_copy_only=False)
        for g, w in zip(good.tolist(), document_words(texts_of(b))):
            c = np.bincount(n_grams(w), minlength=BUCKETS) if len(w) else 0
            raw += c
            if g:
                target += c
    yield pa.RecordBatch.from_arrays([pa.array(range(BUCKETS), pa.int32()), pa.array(raw), pa.array(target)], names=["bucket", "raw", "target"])


def weigher(ratio: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_batches(batches, STEP):
            v = [float(ratio[n_grams(w)].sum()) if len(w) else 0.0 for w in document_words(texts_of(b))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(v, pa.float64())], names=["doc_id", "h", "log_weight"])
    return run


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id",
             label_col: str = "quality", share: float | None = None, target_rows: int = 20_000, seed: int = 11) -> DataFrame:
    """``doc_id, log_weight, gumbel_key, kept``; ``share`` of the documents are kept (default: of good labels)."""
    named = labels.select(column(labels, label_id).alias("doc_id"), column(labels, label_col).alias("q")) \
        .filter("doc_id IS NOT NULL AND q IS NOT NULL").groupBy("doc_id").agg(F.max("q").alias("q"))
    named = materialize(named, "labels")
    known, fine = named.agg(F.count(F.lit(1)), F.count_if(F.col("q") == 1)).first()
    good = named.filter("q = 1").withColumn("h", F.xxhash64(F.lit(seed), "doc_id")) \
        .filter(about("h", 2 * target_rows / max(1, fine)) if fine > 4 * target_rows else F.lit(True)) \
        .orderBy("h", "doc_id").limit(target_rows) \
        .select("doc_id", F.lit(True).alias("good"))
    text = column(docs, text_col)
    d = docs.select(column(docs, id_col).alias("doc_id"), text.alias("text"))
    marked = d.join(F.broadcast(good), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))  # at most target_rows
    sums = map_arrow(marked, counts, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in sums.collect():  # one row per bucket
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    ratio = np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))
    if not fine:
        ratio[:] = 0
    h = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("h")
    w = map_arrow(d.select("doc_id", "text", h), weigher(ratio), "doc_id long, h long, log_weight double")
    u = (F.shiftrightunsigned("h", 11).cast("double") + 0.5) / float(1 << 53)
    w = w.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(u)))
    ranked = positions(w, F.desc("gumbel_key"), F.asc("doc_id"), F.asc("h"), name="weights")
    k = round(ranked.count() * (share if share is not None else fine / known if known else 1.0))
    return ranked.select("doc_id", "log_weight", "gumbel_key", (F.col("position") < k).alias("kept"))

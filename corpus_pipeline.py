"""The corpus pipeline: language ID, exact de-duplication, near de-duplication, source mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casework.llm import exact_dedup, lang_id, mixing, near_dedup, packing
from casework.llm.common import materialize
from casework.llm.queries import tokenizer_file


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language: those without letters, or of no clear language at all, go."""
    return lang_id.known_language(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.drop_copies(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts the row with the smallest id stays."""
    return near_dedup.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents with their place in a sequence."""
    return packing.packed(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("language_id", language), ("exact_dedup", exact_duplicates), ("near_dedup", near_duplicates),
          ("mixing", mix), ("packing", pack)]
#: The network, the sketches and the tokenizer are not SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Corpus pipeline over ``documents``: language, repeated lines, near-duplicates, benchmark leaks, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.llm import decontaminate, language_id, line_dedup, near_dedup, packing
from typeloom.plans.shared import written
from typeloom.plans.ship import ship

WORD = r"[^\x20\x09-\x0D]"


def _with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, ``n_chars`` counted anew."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or without a clear language go."""
    ship(spark)
    found = language_id.identify(docs, language_id.learn(docs))
    return found.where((F.col("lang_pred") != "und") & ~F.col("ambiguous")).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines stay in the first of their documents; a document that has lost all its words goes."""
    ship(spark)
    found = line_dedup.drop_recurring_lines(docs)
    return _with_text(found.where((F.col("n_dropped") == 0) | F.col("text").rlike(WORD)), docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate class stays."""
    ship(spark)
    return near_dedup.keep_first(docs).select(*docs.columns)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of two or more items go; others lose the passages, and go if no word is left."""
    ship(spark)
    found = decontaminate.mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), cut=True)
    return _with_text(found.where((F.col("n_items") < 2) & ((F.col("n_hit") == 0) | F.col("text").rlike(WORD))), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in sequences of 2048 tokens."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontamination", remove_benchmark),
    ("packing", pack_sequences),
]

#: A trained classifier, signatures and a tokenizer: no SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

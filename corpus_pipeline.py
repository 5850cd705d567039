"""A training-data pipeline over documents: each stage is written as Parquet and read again by the next one.

Rows without text or letters go at the first stage. Rows that repeat a doc_id are judged, kept, replaced and drawn alike, and
rows without a doc_id count as one document more. Columns beyond those that a stage names pass through all stages but the
last, whatever their names. An empty table goes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.llm import jaccard_join, langid, mixing, packing, pii
from symgraph.llm.common import fresh, materialise, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognised language."""
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return jaccard_join.keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal values by pseudonyms; n_chars follows the text."""
    renamed = {c: fresh(docs, f"_{c}") for c in docs.columns if c.lower() == "n_values"}  # the stage's own count takes that name
    done = pii.pseudonymise(docs.withColumnsRenamed(renamed), pii.key_of(spark)).withColumn("n_chars", F.when(F.col("n_values") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.select(*(F.col(renamed.get(c, c)).alias(c) for c in docs.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources reach their weights, in shuffled order."""
    renamed = {c: fresh(docs, f"_{c}") for c in docs.columns if c.lower() in ("copy_no", "n_copies")}
    mixed = mixing.mix(docs.withColumnsRenamed(renamed), mixing.rates(docs))
    return mixed.select(*(F.col(renamed.get(c, c)).alias(c) for c in docs.columns))


def packing_plan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts in bins of permitted lengths."""
    return packing.pack(docs.select("doc_id", "text"), with_text=True)


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing to target weights", mixture),
    ("best-fit packing", packing_plan),
]

#: Language ID, the join of near copies and packing are not SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + "-".join(name.lower().split()))
    return docs

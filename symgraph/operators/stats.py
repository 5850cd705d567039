"""Counts, folders, timings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import directory


def index_stats(files: DataFrame, symbols: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes")).join(F.broadcast(symbols.agg(F.count("*").alias("n_symbols"), F.countDistinct("name").alias("n_names"))))


def tier_stats(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy("tier").agg(F.countDistinct("uri").alias("n_files"), F.count("*").alias("n_symbols"))


def folders(files: DataFrame, symbols: DataFrame) -> DataFrame:
    per_file = symbols.groupBy("uri").agg(F.count("*").alias("n"))
    both = files.join(per_file, "uri", "left")
    return both.groupBy(directory(F.col("uri")).alias("folder")).agg(F.count("*").alias("n_files"), F.sum(F.coalesce("n", F.lit(0))).alias("n_symbols"), F.sum("size").alias("bytes"))


def folder_hash(entries: DataFrame) -> DataFrame:
    """entries (folder, name, size, mtime; size null for a folder): one hash for each folder, a level deep."""
    sign = F.when(F.col("size").isNull(), F.concat(F.lit("dir:"), "name")).otherwise(F.concat_ws(":", "name", F.col("size").cast("string"), F.col("mtime").cast("string")))
    return entries.groupBy("folder").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(sign)), "|").cast("binary"), 256).alias("hash"))


def timings(samples: DataFrame, keep: int = 100) -> DataFrame:
    """samples (name, ts, seq, ms): totals, and nearest-rank percentiles over the last keep samples of each name."""
    recent = samples.withColumn("_n", F.row_number().over(W.partitionBy("name").orderBy(F.desc("ts"), F.desc("seq")))).where(F.col("_n") <= keep)
    sorted_ms = F.sort_array(F.collect_list("ms"))
    at = lambda p: F.element_at("_s", F.least(F.floor(F.lit(p) * F.size("_s")).cast("int") + 1, F.size("_s")))
    tail = recent.groupBy("name").agg(sorted_ms.alias("_s")).select("name", at(0.5).alias("p50"), at(0.95).alias("p95"))
    whole = samples.groupBy("name").agg(F.count("*").alias("n"), F.round(F.sum("ms"), 4).alias("total"), F.min("ms").alias("least"), F.max("ms").alias("most"), F.round(F.avg("ms"), 6).alias("mean"))
    return whole.join(tail, "name")


def outliers(samples: DataFrame, k: int = 5, least: float = 10.0) -> DataFrame:
    w = W.partitionBy("name").orderBy(F.desc("ms"), "seq")
    return samples.where(F.col("ms") >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

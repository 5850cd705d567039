"""Cutting the lineage of iterative operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, written to the folder of spark.checkpoint.dir; a local session without one gets a temporary folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            found = "file://" + tempfile.mkdtemp(prefix="symgraph-")
        spark.sparkContext.setCheckpointDir(found)
    return df.checkpoint()

"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where that is unset."""
    for key in ("spark.checkpoint.dir", "spark.gridspark.scratch"):
        if root := spark.conf.get(key, None):
            return root.rstrip("/")
    root = "file://" + tempfile.mkdtemp(prefix="gridspark-")
    spark.conf.set("spark.gridspark.scratch", root)
    return root


def settle(df: DataFrame) -> DataFrame:
    """``df`` written once and read back, so that iterations start from a short lineage."""
    path = f"{folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

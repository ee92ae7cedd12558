"""Cutting lineage: a table in the shared folder that the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_local: dict[str, str] = {}


def place(spark: SparkSession) -> str:
    """A new name in the folder of spark.checkpoint.dir; in a local folder where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        app = spark.sparkContext.applicationId
        at = _local[app] if app in _local else _local.setdefault(app, tempfile.mkdtemp(prefix="notegraph-"))
    return f"{at.rstrip('/')}/notegraph/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table at a place of its own."""
    path = place(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

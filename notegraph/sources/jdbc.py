"""The tables of a store in a database, over JDBC (SC15, SC16)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.operators.store import VERSION_SCHEMA


def read(spark: SparkSession, url: str, name: str, key: str = "id", parts: int = 16, **options: str) -> DataFrame:
    """A table in ``parts`` ranges of ``key``, whose bounds are asked for first."""
    reader = spark.read.format("jdbc").options(url=url, **options)
    low, high = reader.option("query", f"SELECT min({key}) AS a, max({key}) AS b FROM {name}").load().first()
    if low is None:
        return reader.option("dbtable", name).load()
    split = {"partitionColumn": key, "lowerBound": str(low), "upperBound": str(high + 1), "numPartitions": str(parts)}
    return reader.options(dbtable=name, **split).load()


def versions(spark: SparkSession, url: str, name: str = "versions", **options: str) -> DataFrame:
    """The version log; front matter comes as JSON text."""
    rows = read(spark, url, name, **options).withColumn("frontmatter", F.try_parse_json(F.col("frontmatter").cast("string")))
    return rows.select([f.split()[0] for f in VERSION_SCHEMA.split(", ")])


def write(rows: DataFrame, url: str, name: str, mode: str = "append", **options: str) -> None:
    plain = [F.to_json(c).alias(c) if t == "variant" else F.col(c) for c, t in rows.dtypes]
    rows.select(*plain).write.format("jdbc").options(url=url, dbtable=name, **options).mode(mode).save()

"""Folders of Markdown files as documents, and documents as files (SC11-SC14, SC17, SC18)."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notegraph.functions import columns, text
from notegraph.operators.cut import written
from notegraph.plans.visibility import matches_any


def files(spark: SparkSession, root: str, include: tuple[str, ...] = ("**",), exclude: tuple[str, ...] = ()) -> DataFrame:
    """(path, content) of the .md files below ``root``; folders that start with a dot are skipped."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    path = F.substring("path", len(full) + 2, 1 << 30)
    rows = raw.select(path.alias("path"), F.col("content").cast("string").alias("content"))
    rows = rows.where(~(F.col("path").startswith(".") | F.col("path").contains("/.")) & matches_any(F.col("path"), include))
    return rows.where(~matches_any(F.col("path"), exclude)) if exclude else rows


def parsed(rows: DataFrame) -> DataFrame:
    """(path, path_norm, frontmatter_raw, frontmatter, error, body, content_hash) of files."""

    @F.pandas_udf("struct<raw:string,body:string>")
    def cut(content: pd.Series) -> pd.DataFrame:
        found = [text.split((c or "").replace("\r\n", "\n")) for c in content]
        return pd.DataFrame([(text.without_properties(r)[0], b) for r, b in found], columns=["raw", "body"])

    rows = rows.withColumn("s", cut("content")).select("path", F.col("s.raw").alias("frontmatter_raw"), F.col("s.body").alias("body"))
    rows = rows.withColumn("p", columns.parsed_frontmatter("frontmatter_raw"))
    return rows.select(
        "path",
        columns.fold_path("path").alias("path_norm"),
        "frontmatter_raw",
        F.try_parse_json("p.json").alias("frontmatter"),
        F.col("p.error").alias("error"),
        "body",
        columns.content_hash(F.col("frontmatter_raw"), F.col("body")).alias("content_hash"),
    )


def seeded(rows: DataFrame, repo_id: int = 1, author: str = "seed", start: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """Parsed files as the first versions of documents, numbered by path: ranges of paths are numbered each, and
    the paths of the ranges before are added."""
    dealt = written(
        rows.select("path")
        .repartitionByRange("path")
        .withColumn("part", F.spark_partition_id())
        .withColumn("own", F.row_number().over(Window.partitionBy("part").orderBy("path")))
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = dealt.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    numbered = dealt.join(starts, "part").select("path", (F.col("start") + F.col("own")).cast("long").alias("id"))
    made = F.date_format(F.timestamp_millis(F.unix_millis(F.to_timestamp(F.lit(start))) + F.col("id") * 1000), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return rows.join(numbered, "path").select(
        "id", F.col("id").alias("document_id"), F.lit(repo_id).cast("long").alias("repo_id"), F.lit(None).cast("long").alias("prev_id"),
        "path", "path_norm", "frontmatter_raw", "frontmatter", "body", F.lit(author).alias("author"), made.alias("created_at"), "content_hash",
    )


def rendered(rows: DataFrame) -> DataFrame:
    """(path, content): files with ``$version`` and ``$content_hash`` lines, as a working copy has them."""
    raw = F.coalesce("frontmatter_raw", F.lit(""))
    ended = F.when((raw == "") | raw.endswith("\n"), raw).otherwise(F.concat(raw, F.lit("\n")))
    own = columns.content_hash(raw, F.col("body"))
    stamped = F.concat(ended, F.lit("$version: v"), F.col("id").cast("string"), F.lit("\n$content_hash: "), own, F.lit("\n"))
    return rows.select("path", columns.canonical(stamped, F.col("body")).alias("content"))


def materialize(rows: DataFrame, root: str) -> int:
    """Rendered files below ``root``, a folder that all executors mount; the number written."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                at = os.path.join(root, path)
                os.makedirs(os.path.dirname(at), exist_ok=True)
                with open(at + ".part", "w", newline="") as f:
                    f.write(content)
                os.replace(at + ".part", at)
            yield pd.DataFrame({"n": [len(batch)]})

    done = rendered(rows).mapInPandas(write, "n long").agg(F.sum("n").alias("n")).first()
    return int(done.n or 0) if done else 0


def apply_refs(effects: DataFrame, versions: DataFrame, root: str) -> int:
    """The net effects of a feed page (``sync.net_effect``) on a folder: files of documents that moved
    away or were deleted go, the others are written. Applying a page twice changes nothing more."""
    gone = effects.where((F.col("prev_path").isNotNull() & (F.col("prev_path") != F.col("path"))) | (F.col("op") == "delete"))

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["prev_path"].dropna():
                at = os.path.join(root, path)
                if os.path.exists(at):
                    os.remove(at)
            yield pd.DataFrame({"n": [len(batch)]})

    removed = gone.select("prev_path").mapInPandas(remove, "n long").agg(F.sum("n").alias("n")).first()
    kept = versions.join(effects.where("op <> 'delete'").select("id"), "id", "left_semi")
    return int(removed.n or 0) + materialize(kept, root)


def ndjson(refs: DataFrame, folder: str) -> None:
    """One reference a line."""
    refs.select("id", "prev_id", "repo_id", "path", "prev_path", "content_hash", "op", "created_at").write.mode("append").json(folder)

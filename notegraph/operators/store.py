"""The tables of a snapshot, and scans over them (SC1-SC10)."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.functions.text import exact_path, fold

VERSION_SCHEMA = (
    "id long, document_id long, repo_id long, prev_id long, path string, path_norm string, frontmatter_raw string, "
    "frontmatter variant, body string, author string, created_at string, content_hash string"
)
LINK_SCHEMA = "repo_id long, source_id long, ord int, field string, target_raw string, target_norm string, target_id long"
CHUNK_SCHEMA = "version_id long, ix int, text string, text_hash string, model string, embedding array<float>"
BACKLOG_SCHEMA = "version_id long, attempts int, last_error string, next_retry_at string"


@dataclass(frozen=True)
class Store:
    """``versions`` is append-only; which of them are live follows from ``prev_id``. A large store keeps
    two tables derived from it: ``current``, its live rows, which spares the anti-join of the log, and
    ``indexed``, the terms of each version (``fulltext.tokens``), which spares reading bodies again."""

    versions: DataFrame
    links: DataFrame | None = None
    chunks: DataFrame | None = None
    backlog: DataFrame | None = None
    documents: DataFrame | None = None
    repos: DataFrame | None = None
    current: DataFrame | None = None
    indexed: DataFrame | None = None

    @property
    def live(self) -> DataFrame:
        return live(self.versions) if self.current is None else self.current

    def with_(self, **tables: DataFrame) -> Store:
        return replace(self, **tables)


def live(versions: DataFrame) -> DataFrame:
    """Versions that no other follows. Of the other side only the ids of predecessors are shuffled; of this one,
    whole rows, unless the log is bucketed by ``id``. A large store keeps its live rows as a table, which
    ``advanced`` moves along."""
    followed = versions.where("prev_id IS NOT NULL").select(F.col("prev_id").alias("id"))
    return versions.join(followed, "id", "left_anti")


def advanced(current: DataFrame, added: DataFrame) -> DataFrame:
    """``current`` after the versions in ``added`` were appended: what they follow goes, and those that
    nothing follows come. Only the ids of ``added`` meet the live rows."""
    followed = added.where("prev_id IS NOT NULL").select(F.col("prev_id").alias("id"))
    return current.join(followed, "id", "left_anti").unionByName(live(added))


def with_next(versions: DataFrame) -> DataFrame:
    """``next_id``: the version that follows, the least one if a fault has given it several."""
    after = versions.where("prev_id IS NOT NULL").groupBy("prev_id").agg(F.min("id").alias("next_id"))
    return versions.join(after.withColumnRenamed("prev_id", "id"), "id", "left")


def scan_live(live_rows: DataFrame, repo_id: int) -> DataFrame:
    return live_rows.where(F.col("repo_id") == repo_id).orderBy("path")


def by_path(live_rows: DataFrame, repo_id: int, path: str) -> DataFrame:
    return live_rows.where((F.col("repo_id") == repo_id) & (F.col("path_norm") == fold(exact_path(path))))


def by_paths(live_rows: DataFrame, repo_id: int, paths: Iterable[str]) -> DataFrame:
    """The request is as long as a caller wrote it, so it is a literal list."""
    return live_rows.where((F.col("repo_id") == repo_id) & F.col("path_norm").isin(sorted({fold(exact_path(p)) for p in paths})))


def by_documents(live_rows: DataFrame, documents: DataFrame) -> DataFrame:
    return live_rows.join(documents.select("document_id").distinct(), "document_id", "left_semi")


def matching(live_rows: DataFrame, patterns: Iterable[str]) -> DataFrame:
    """Documents whose path matches any regular expression; none match an empty list."""
    found = F.lit(False)
    for p in patterns:
        found = found | F.col("path").rlike(p)
    return live_rows.where(found).select("document_id")


def index_page(live_rows: DataFrame, after: int, through: int, size: int = 1000) -> DataFrame:
    """(id, path, content_hash) of live rows with after < id <= through, by id."""
    page = live_rows.where((F.col("id") > after) & (F.col("id") <= through))
    return page.select("id", "path", "content_hash").orderBy("id").limit(size)

"""Writes as appended versions: create, put, move, delete, append, and the tables around them (WR1-WR12)."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notegraph.config import PathConfig
from notegraph.errors import EngineError
from notegraph.functions import text
from notegraph.operators.store import VERSION_SCHEMA, by_path, by_paths, live
from notegraph.operators.links import LinkConfig
from notegraph.plans.visibility import Visibility, has_sigil

ANONYMOUS = "anonymous"
GET_MANY, RETRIES = 50, 5


@dataclass(frozen=True)
class Op:
    """One write. ``kind``: create, put, delete. ``prev``: the version it builds on."""

    kind: str
    path: str
    body: str = ""
    raw: str | None = None
    frontmatter: dict | None = None
    prev: int | None = None
    new_path: str | None = None
    author: str = ANONYMOUS


def raw_of(op: Op) -> str:
    """The front matter as stored: given as text or as a map, not both; ``$`` lines are left out."""
    if op.raw is not None and op.frontmatter is not None:
        raise EngineError("frontmatter_invalid", "give the front matter as text or as a map")
    raw = op.raw if op.raw is not None else text.dump({k: v for k, v in (op.frontmatter or {}).items() if not k.startswith("$")})
    raw = text.without_properties(raw)[0]
    text.parse(raw)
    return raw


def now_text() -> str:
    return dt.datetime.now(dt.UTC).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"


def version_row(id_: int, document: int, repo: int, prev: int | None, path: str, raw: str, body: str, author: str, at: str) -> dict:
    return {
        "id": id_, "document_id": document, "repo_id": repo, "prev_id": prev, "path": path, "path_norm": text.fold(path),
        "frontmatter_raw": raw, "frontmatter": text.to_json(text.parse(raw)), "body": body, "author": author,
        "created_at": at, "content_hash": text.content_hash(raw, body),
    }


def version_frame(spark: SparkSession, rows: Sequence[dict]) -> DataFrame:
    plain = VERSION_SCHEMA.replace("frontmatter variant", "frontmatter string")
    names = [f.split()[0] for f in plain.split(", ")]
    made = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], plain)
    return made.withColumn("frontmatter", F.parse_json("frontmatter")).select(names)


def get(live_rows: DataFrame, repo: int, path: str) -> Row:
    found = by_path(live_rows, repo, path).limit(1).collect()
    if not found:
        raise EngineError("doc_not_found", path)
    return found[0]


def get_many(live_rows: DataFrame, repo: int, paths: Sequence[str]) -> dict[str, Row | EngineError]:
    """A document or an error for each path; paths with one key are read once."""
    if len(paths) > GET_MANY:
        raise EngineError("payload_too_large", f"at most {GET_MANY} paths")
    out: dict[str, Row | EngineError] = {}
    keys: dict[str, str] = {}
    for p in paths:
        try:
            keys[p] = text.fold(text.exact_path(p))
        except EngineError as e:
            out[p] = e
    rows = {r.path_norm: r for r in by_paths(live_rows, repo, [p for p in paths if p in keys]).collect()} if keys else {}
    for p, k in keys.items():
        out[p] = rows.get(k) or EngineError("doc_not_found", p)
    return out


def get_version(versions: DataFrame, ref: str, repo: int | None = None) -> Row:
    number = ref[1:]
    found = versions.where(F.col("id") == int(number)).limit(1).collect() if ref[:1] == "v" and number.isdigit() else []
    if not found or (repo is not None and found[0].repo_id != repo):
        raise EngineError("version_not_found", ref)
    return found[0]


def apply(
    versions: DataFrame, repo: int, ops: Sequence[Op], at: str | None = None, paths: PathConfig = PathConfig()
) -> tuple[DataFrame, list[int]]:
    """``versions`` with the writes appended, all or none, and the id of each op's version. ``paths``: the
    configuration in effect in the repository (``Repos.paths``).

    Ops are few and come from callers; the live rows they touch are fetched at once by key. Later ops
    see earlier ones.
    """
    spark = versions.sparkSession
    at = at or now_text()
    touched = {text.fold(text.exact_path(p, paths)) for o in ops for p in (o.path, o.new_path) if p}
    now = live(versions)
    held = {r.path_norm: r.asDict() for r in now.where((F.col("repo_id") == repo) & F.col("path_norm").isin(sorted(touched))).collect()}
    top = versions.agg(F.max("id").alias("v"), F.max("document_id").alias("d")).first()
    next_id, next_doc = (top.v or 0) + 1, (top.d or 0) + 1
    rows: list[dict] = []
    ids: list[int] = []
    for o in ops:
        path = text.exact_path(o.path, paths)
        key = text.fold(path)
        current = held.get(key)
        if o.kind == "create":
            if current:
                raise EngineError("create_conflict", path)
            row = version_row(next_id, next_doc, repo, None, path, raw_of(o), o.body, o.author, at)
            next_doc += 1
        elif o.kind == "put":
            if not current:
                raise EngineError("doc_not_found", path)
            if o.prev != current["id"]:
                raise EngineError("stale_prev", path, current=current["id"])
            to = text.exact_path(o.new_path, paths) if o.new_path else current["path"]
            if text.fold(to) != key and text.fold(to) in held:
                raise EngineError("path_taken", to)
            row = version_row(next_id, current["document_id"], repo, current["id"], to, raw_of(o), o.body, o.author, at)
        elif o.kind == "delete":
            if not current:
                # Deleting what an earlier version shows as deleted is no error.
                gone = versions.where((F.col("repo_id") == repo) & (F.col("path_norm") == key)).orderBy(F.desc("id")).limit(1).collect()
                if not gone:
                    raise EngineError("doc_not_found", path)
                ids.append(gone[0].id)
                continue
            if o.prev is not None and o.prev != current["id"]:
                raise EngineError("stale_prev", path, current=current["id"])
            to = text.deleted_path(current["path"], current["id"], paths.system_sigils[0])
            row = version_row(next_id, current["document_id"], repo, current["id"], to, current["frontmatter_raw"], current["body"], o.author, at)
        else:
            raise EngineError("unknown_arg", f"kind {o.kind!r}")
        held.pop(key, None)
        held[row["path_norm"]] = row
        rows.append(row)
        ids.append(next_id)
        next_id += 1
    return (versions.unionByName(version_frame(spark, rows)) if rows else versions), ids


def append(versions: DataFrame, repo: int, path: str, addition: str, author: str = "anonymous") -> tuple[DataFrame, int]:
    """The addition at the end of the body, as a new version."""
    if not addition:
        raise EngineError("empty_append", path)
    for attempt in range(RETRIES):
        current = get(live(versions), repo, path)
        body = current.body if not current.body or current.body.endswith("\n") else current.body + "\n"
        try:
            out, ids = apply(versions, repo, [Op("put", path, body + addition, raw=current.frontmatter_raw, prev=current.id, author=author)])
        except EngineError as e:
            if e.code != "stale_prev" or attempt == RETRIES - 1:
                raise
            continue
        return out, ids[0]
    raise EngineError("stale_prev", path)


def enqueue(backlog: DataFrame, waiting: DataFrame) -> DataFrame:
    """The backlog with ``waiting`` added; the last row of each version wins."""
    both = backlog.withColumn("_new", F.lit(0)).unionByName(waiting.withColumn("_new", F.lit(1)))
    order = Window.partitionBy("version_id").orderBy(F.desc("_new"), F.desc("attempts"))
    return both.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_new", "_r")


def due(backlog: DataFrame, now: str) -> DataFrame:
    return backlog.where(F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now))


def dequeue(backlog: DataFrame, now: str, limit: int) -> DataFrame:
    return due(backlog, now).orderBy(F.asc_nulls_first("next_retry_at"), "version_id").limit(limit)


def backlog_status(backlog: DataFrame, now: str) -> DataFrame:
    """One row: pending, due, failing, oldest_retry."""
    return backlog.agg(
        F.count(F.lit(1)).alias("pending"),
        F.count_if(F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now)).alias("due"),
        F.count_if(F.col("attempts") > 0).alias("failing"),
        F.min("next_retry_at").alias("oldest_retry"),
    )


def last_errors(backlog: DataFrame, n: int = 5) -> DataFrame:
    return backlog.where("last_error IS NOT NULL").orderBy(F.desc_nulls_last("next_retry_at"), "version_id").limit(n)


@dataclass
class Repos:
    """Repositories: a table of a few rows, kept by the driver, under the server's configuration."""

    rows: list[dict]
    server_paths: PathConfig = PathConfig()
    server_links: LinkConfig = LinkConfig()

    def get(self, slug: str) -> dict:
        found = next((r for r in self.rows if r["slug_norm"] == text.fold(slug)), None)
        if not found:
            raise EngineError("repo_not_found", slug)
        return found

    def create(self, slug: str, at: str | None = None) -> dict:
        text.check_slug(slug, self.server_paths)
        if any(r["slug_norm"] == text.fold(slug) for r in self.rows):
            raise EngineError("slug_taken", slug)
        row = {"id": max((r["id"] for r in self.rows), default=0) + 1, "slug": slug, "slug_norm": text.fold(slug), "path_config": None, "link_config": None, "created_at": at or now_text()}
        self.rows.append(row)
        return row

    def rename(self, slug: str, new: str) -> dict:
        row = self.get(slug)
        text.check_slug(new, self.server_paths)
        if any(r is not row and r["slug_norm"] == text.fold(new) for r in self.rows):
            raise EngineError("slug_taken", new)
        row |= {"slug": new, "slug_norm": text.fold(new)}
        return row

    def delete(self, slug: str) -> dict:
        row = self.get(slug)
        row["slug"] = f"{self.server_paths.system_sigils[0]}deleted-{row['slug']}-{row['id']}"
        row["slug_norm"] = text.fold(row["slug"])
        return row

    def configure(self, slug: str, **config: dict | None) -> dict:
        """Store a path or link configuration, or take it away (None). Of a bad one nothing is stored.
        ``path_warnings`` tells what the new one refuses, ``links.reindexed`` reads links again under it."""
        row = self.get(slug)
        own = {k: v if v is None else json.dumps(v) for k, v in config.items() if k in ("path_config", "link_config")}
        self.server_paths.layered(own.get("path_config"))
        self.server_links.layered(own.get("link_config"))
        row |= own
        return row

    def paths(self, slug: str) -> PathConfig:
        return self.server_paths.layered(self.get(slug)["path_config"])

    def links(self) -> dict[int, LinkConfig]:
        """The link configuration in effect, by repository."""
        return {r["id"]: self.server_links.layered(r["link_config"]) for r in self.rows}

    def visibility(self, seen: Visibility = Visibility()) -> Visibility:
        """``seen`` with the sigils and slugs of the repositories."""
        own = {r["id"]: self.server_paths.layered(r["path_config"]) for r in self.rows}
        return replace(seen, sigils={i: (c.hidden_sigils, c.system_sigils) for i, c in own.items()}, slugs={r["id"]: r["slug"] for r in self.rows})

    def frame(self, spark: SparkSession) -> DataFrame:
        schema = "id long, slug string, slug_norm string, path_config string, link_config string, created_at string"
        return spark.createDataFrame([tuple(r[n.split()[0]] for n in schema.split(", ")) for r in self.rows], schema)


def path_warnings(live_rows: DataFrame, config: PathConfig = PathConfig()) -> DataFrame:
    """(id, path, reason) of live documents, but those of the system, whose path ``config`` would refuse. They are
    neither hidden nor changed."""
    path = F.col("path")
    reason = F.when(path.rlike(r"(^|/)(\.{0,2})(/|$)"), "reserved segment")
    for c in config.disallowed_chars:
        reason = reason.when(path.contains(c), f"character {c}")
    own = live_rows.where(~has_sigil(path, config.system_sigils))
    return own.select("id", "path", reason.alias("reason")).where("reason IS NOT NULL")

"""The query: visibility, filter, text and vector modes, order, limit and projection (PR, FP, SL, ST2)."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegraph.errors import EngineError, filter_invalid
from notegraph.functions import columns
from notegraph.operators import fulltext, vectors
from notegraph.operators.store import Store
from notegraph.plans import cel
from notegraph.plans.compile import Tables, compile_filter
from notegraph.plans.visibility import Visibility, slug_matches

LIMIT = 50


@dataclass(frozen=True)
class QuerySpec:
    repos: tuple[str, ...] = ("*",)
    filter: str | None = None
    text: str | None = None
    semantic: tuple[float, ...] | None = None
    select: tuple[str, ...] = ("$path",)
    limit: int = LIMIT
    visibility: Visibility = Visibility()
    stemmed: bool = True


def intrinsics() -> dict[str, Column]:
    return {
        "$path": F.col("path"),
        "$repo": F.col("repo_id"),
        "$version_id": columns.version_ref(F.col("id")),
        "$prev_version_id": columns.version_ref(F.col("prev_id")),
        "$next_version_id": F.lit(None).cast("string"),
        "$updated_at": F.col("created_at"),
        "$author": F.col("author"),
        "$body": F.col("body"),
        "$content_hash": F.coalesce("content_hash", columns.content_hash(F.coalesce("frontmatter_raw", F.lit("")), F.col("body"))),
    }


def validate(spec: QuerySpec) -> None:
    if spec.limit < 0:
        raise filter_invalid("limit must not be negative")
    if spec.semantic is not None and not spec.semantic:
        raise filter_invalid("semantic needs a vector")
    if not spec.select:
        raise filter_invalid("select must name something")
    known = {*intrinsics(), *(["$semantic_score"] if spec.semantic is not None else [])}
    for name in spec.select:
        if name.startswith("$") and name not in known:
            raise filter_invalid(f"unknown intrinsic {name}", expected=sorted(known))


def resolve_repos(repos: DataFrame | None, patterns: Sequence[str]) -> list[int] | None:
    """Ids by slug or glob, None for all; repositories in the system's namespace are never addressed."""
    if repos is None:
        if tuple(patterns) != ("*",):
            raise EngineError("repo_not_found", "no repositories here")
        return None
    rows = [r for r in repos.select("id", "slug").collect() if not r.slug.startswith(":")]
    found = sorted({r.id for r in rows for p in patterns if slug_matches(r.slug, p)})
    for p in patterns:
        if "*" not in p and not any(r.slug == p for r in rows):
            raise EngineError("repo_not_found", p)
    return found


def project(rows: DataFrame, select: Sequence[str]) -> DataFrame:
    """Intrinsics by name, front matter keys as variants; a key that a row lacks is NULL."""
    known = intrinsics()
    out = []
    for name in select:
        if name == "$semantic_score":
            out.append((1 - F.col("_distance")).alias(name))
        elif name.startswith("$"):
            out.append(known[name].alias(name))
        else:
            where = "$" + "".join(f'["{f}"]' for f in name.split("."))
            out.append(F.try_variant_get("frontmatter", where, "variant").alias(name))
    return rows.select(*out)


def hits(rows: DataFrame) -> list[dict]:
    """Collected hits; keys that a row lacks are left out."""
    found = rows.select(*[F.to_json(F.col(f"`{c}`")).alias(c) if t == "variant" else F.col(f"`{c}`") for c, t in rows.dtypes])
    kinds = dict(rows.dtypes)
    return [
        {k: json.loads(v) if kinds[k] == "variant" else v for k, v in r.asDict().items() if v is not None}
        for r in found.collect()
    ]


def etag(found: list[dict]) -> str:
    return hashlib.sha256(json.dumps(found, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()[:16]


def selected(store: Store, spec: QuerySpec, live: DataFrame | None = None) -> DataFrame:
    """The live rows that match, with ``_rank`` columns for the order, before the limit."""
    validate(spec)
    tree = cel.parse(spec.filter) if spec.filter else None
    live = store.live if live is None else live
    rows = live.where(spec.visibility.visible())
    repos = resolve_repos(store.repos, spec.repos)
    if repos is not None:
        rows = rows.where(F.col("repo_id").isin(repos) if repos else F.lit(False))
    if spec.semantic is not None:
        if store.chunks is None:
            raise EngineError("semantic_unavailable", "no chunks here")
        # The cut comes before the filters: it is observable.
        near = vectors.nearest(store.chunks, rows, spec.semantic, vectors.candidates(spec.limit))
        rows = rows.join(near.select(F.col("version_id").alias("id"), F.col("distance").alias("_distance")), "id")
    if tree is not None:
        links = store.links
        tables = Tables(live, links, spec.visibility) if links is not None else None
        rows = compile_filter(tree, tables).apply(rows)
    if spec.text is not None:
        query = fulltext.parse(spec.text, spec.stemmed)
        if store.indexed is not None:
            indexed = store.indexed.join(rows.select("id"), "id", "left_semi")
        else:
            indexed = fulltext.tokens(rows, spec.stemmed)
        rows = rows.join(fulltext.bm25(indexed, query).withColumnRenamed("score", "_score"), "id")
    return rows


def order(spec: QuerySpec) -> list[Column]:
    if spec.semantic is not None:
        return [F.asc("_distance"), F.desc("id")]
    if spec.text is not None:
        return [F.desc("_score"), F.desc("id")]
    return [F.desc("created_at"), F.desc("id")]


def run_query(store: Store, spec: QuerySpec, live: DataFrame | None = None) -> DataFrame:
    """Hits in order, at most ``spec.limit``."""
    rows = selected(store, spec, live)
    return project(rows.orderBy(*order(spec)).limit(spec.limit), spec.select)

"""Read-only integrity scrub: every derived fact is derived again and compared (VF1-VF7)."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegraph.functions import columns
from notegraph.operators import links as link_ops
from notegraph.operators.cut import written
from notegraph.operators.store import Store, live, with_next

# The checks and their severities.
SEVERITY = {
    "chain.orphan_document": "warn",
    "chain.multiple_current": "error",
    "chain.no_current": "error",
    "chain.repo_mismatch": "error",
    "chain.broken_prev": "error",
    "chain.prev_next_asymmetry": "error",
    "chain.cycle": "error",
    "chain.multiple_live_at_path": "error",
    "hash.missing": "warn",
    "hash.mismatch": "error",
    "frontmatter.system_leak": "error",
    "frontmatter.parse_error": "error",
    "frontmatter.divergence": "error",
    "fts.missing": "error",
    "fts.orphan": "error",
    "chunks.orphan": "error",
    "chunks.backlog_orphan": "error",
    "chunks.mixed_dim": "error",
    "chunks.unembedded": "warn",
    "links.set_mismatch": "error",
    "links.misresolved_dangling": "error",
    "links.misresolved_bound": "error",
    "links.self_link": "warn",
    "links.deleted_source_has_outbound": "error",
}
WHOLE_STORE = ("fts.missing", "fts.orphan", "chunks.orphan", "chunks.backlog_orphan", "chunks.mixed_dim")
FINDING = "check string, severity string, repo_id long, document_id long, version_id long, path string, detail string"


def finding(rows: DataFrame, check: str, detail: Column | None = None, **ids: Column | str) -> DataFrame:
    """``rows`` as findings of ``check``. ids: repo_id, document_id, version_id, path where known."""
    at = lambda name, kind: (F.col(ids[name]) if isinstance(ids[name], str) else ids[name]).cast(kind) if name in ids else F.lit(None).cast(kind)  # type: ignore[union-attr]
    return rows.select(
        F.lit(check).alias("check"),
        F.lit(SEVERITY[check]).alias("severity"),
        at("repo_id", "long").alias("repo_id"),
        at("document_id", "long").alias("document_id"),
        at("version_id", "long").alias("version_id"),
        at("path", "string").alias("path"),
        (F.lit("") if detail is None else detail).cast("string").alias("detail"),
    )


def with_stored_next(versions: DataFrame) -> DataFrame:
    return versions if "next_id" in versions.columns else with_next(versions)


def chain_checks(versions: DataFrame, documents: DataFrame | None) -> list[DataFrame]:
    """``versions`` may carry a stored next_id; without it the one that follows from prev_id is used."""
    v = with_stored_next(versions)
    out = []
    if documents is not None:
        lone = documents.join(versions.select("document_id").distinct(), "document_id", "left_anti")
        out.append(finding(lone, "chain.orphan_document", repo_id="repo_id", document_id="document_id"))
        owner = documents.select("document_id", F.col("repo_id").alias("_repo"))
        other = v.join(owner, "document_id").where("repo_id <> _repo")
        out.append(finding(other, "chain.repo_mismatch", repo_id="repo_id", document_id="document_id", version_id="id", path="path"))
    heads = v.groupBy("document_id").agg(F.count_if(F.col("next_id").isNull()).alias("n"), F.min("repo_id").alias("repo_id"))
    out.append(finding(heads.where("n > 1"), "chain.multiple_current", F.col("n"), repo_id="repo_id", document_id="document_id"))
    out.append(finding(heads.where("n = 0"), "chain.no_current", repo_id="repo_id", document_id="document_id"))
    own = v.select(F.col("document_id").alias("d"), F.col("id").alias("i"), F.col("prev_id").alias("p"), F.col("next_id").alias("n"))
    for way, pointer, back in (("prev", "prev_id", "n"), ("next", "next_id", "p")):
        joined = v.where(F.col(pointer).isNotNull()).join(own, (F.col("document_id") == F.col("d")) & (F.col(pointer) == F.col("i")), "left")
        ids = {"repo_id": "repo_id", "document_id": "document_id", "version_id": "id", "path": "path"}
        out.append(finding(joined.where("i IS NULL"), "chain.broken_prev", F.concat(F.lit(f"{way} "), F.col(pointer)), **ids))
        bad = joined.where(F.col("i").isNotNull() & ~F.col(back).eqNullSafe(F.col("id")))
        out.append(finding(bad, "chain.prev_next_asymmetry", F.concat(F.lit(f"{way} "), F.col(pointer)), **ids))
    norm = columns.fold_path("path") if "path_norm" not in v.columns else F.col("path_norm")
    at_path = v.where("next_id IS NULL").groupBy("repo_id", norm.alias("path")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    out.append(finding(at_path, "chain.multiple_live_at_path", F.col("n"), repo_id="repo_id", path="path"))
    return out


def cycles(versions: DataFrame, rounds: int = 40) -> DataFrame:
    """Versions whose backward walk from a current row never ends. Pointers are doubled ``rounds``
    times, so a walk of 2**rounds steps is a cycle; the loop stops once every walk has ended."""
    v = with_stored_next(versions)
    step = written(v.where("prev_id IS NOT NULL").select("id", F.col("prev_id").alias("up")))
    walks = written(v.where("next_id IS NULL").join(step, "id").select("id", "repo_id", "document_id", "path", "up"))
    total = step.count()
    reach = 1
    while reach <= total and rounds and walks.limit(1).count():
        hop = step.select(F.col("id").alias("up"), F.col("up").alias("further"))
        walks = written(walks.join(hop, "up").drop("up").withColumnRenamed("further", "up"))
        step = written(step.join(hop, "up").select("id", F.col("further").alias("up")))
        reach, rounds = 2 * reach, rounds - 1
    return finding(walks, "chain.cycle", repo_id="repo_id", document_id="document_id", version_id="id", path="path")


def hash_checks(versions: DataFrame) -> list[DataFrame]:
    ids = {"repo_id": "repo_id", "document_id": "document_id", "version_id": "id", "path": "path"}
    own = columns.content_hash(F.coalesce("frontmatter_raw", F.lit("")), F.col("body"))
    return [
        finding(versions.where("content_hash IS NULL"), "hash.missing", **ids),
        finding(versions.where(F.col("content_hash") != own), "hash.mismatch", own, **ids),
    ]


def frontmatter_checks(versions: DataFrame) -> list[DataFrame]:
    ids = {"repo_id": "repo_id", "document_id": "document_id", "version_id": "id", "path": "path"}
    leak = versions.where(
        F.coalesce("frontmatter_raw", F.lit("")).rlike(r"(?m)^\$")
        | F.exists(F.coalesce(F.json_object_keys(F.to_json("frontmatter")), F.array().cast("array<string>")), lambda k: k.startswith("$"))
    )
    read = versions.withColumn("p", columns.parsed_frontmatter(F.coalesce("frontmatter_raw", F.lit(""))))
    same = F.to_json(F.try_parse_json("p.json")) == F.to_json("frontmatter")
    return [
        finding(leak, "frontmatter.system_leak", **ids),
        finding(read.where("p.error IS NOT NULL"), "frontmatter.parse_error", F.col("p.error"), **ids),
        finding(read.where(F.col("p.error").isNull() & ~F.coalesce(same, F.lit(False))), "frontmatter.divergence", **ids),
    ]


def fts_checks(versions: DataFrame, indexed: DataFrame) -> list[DataFrame]:
    """``indexed``: the ids that the text index holds."""
    held = indexed.select("id").distinct()
    ids = {"repo_id": "repo_id", "document_id": "document_id", "version_id": "id", "path": "path"}
    return [
        finding(versions.join(held, "id", "left_anti"), "fts.missing", **ids),
        finding(held.join(versions.select("id"), "id", "left_anti"), "fts.orphan", version_id="id"),
    ]


def chunk_checks(versions: DataFrame, chunks: DataFrame, backlog: DataFrame | None, embedding: bool = True) -> list[DataFrame]:
    known = versions.select(F.col("id").alias("version_id"))
    held = chunks.select("version_id").distinct()
    sizes = chunks.where("embedding IS NOT NULL").groupBy("version_id").agg(
        F.min(F.size("embedding")).alias("a"), F.max(F.size("embedding")).alias("b")
    )
    out = [
        finding(held.join(known, "version_id", "left_anti"), "chunks.orphan", version_id="version_id"),
        finding(sizes.where("a <> b"), "chunks.mixed_dim", F.concat_ws(",", "a", "b"), version_id="version_id"),
    ]
    if backlog is not None:
        waiting = backlog.select("version_id").distinct()
        out.append(finding(waiting.join(known, "version_id", "left_anti"), "chunks.backlog_orphan", version_id="version_id"))
        if embedding:
            now = live(versions).where("trim(coalesce(body, '')) <> ''").withColumnRenamed("id", "version_id")
            lost = now.join(held, "version_id", "left_anti").join(waiting, "version_id", "left_anti")
            out.append(finding(lost, "chunks.unembedded", repo_id="repo_id", document_id="document_id", version_id="version_id", path="path"))
    return out


def link_checks(versions: DataFrame, links: DataFrame, configs: link_ops.Configs = link_ops.LinkConfig(), extract: bool = True) -> list[DataFrame]:
    now = live(versions)
    out = []
    ids = {"repo_id": "repo_id", "document_id": "source_id"}
    name = F.concat_ws(" ", "ord", "field", "target_raw")
    if extract:
        key = ["repo_id", "source_id", "ord", "field", "target_raw"]
        derived = link_ops.backfill(now, configs).select(key)
        stored = links.select(key)
        for way, diff in (("missing", derived.exceptAll(stored)), ("extra", stored.exceptAll(derived))):
            out.append(finding(diff, "links.set_mismatch", F.concat(F.lit(way + " "), name), **ids))
    at = now.select(F.col("repo_id").alias("r"), F.col("path_norm").alias("n"), F.col("document_id").alias("t"))
    dangling = links.where("target_id IS NULL").join(at, (F.col("repo_id") == F.col("r")) & (F.col("target_norm") == F.col("n")))
    out.append(finding(dangling.where("t <> source_id"), "links.misresolved_dangling", name, **ids))
    bound = links.where("target_id IS NOT NULL")
    ever = versions.select(F.col("document_id").alias("target_id"), F.col("path_norm").alias("target_norm")).distinct()
    out.append(finding(bound.join(ever, ["target_id", "target_norm"], "left_anti"), "links.misresolved_bound", name, **ids))
    out.append(finding(links.where("target_id = source_id"), "links.self_link", name, **ids))
    gone = now.where(columns_deleted()).select(F.col("document_id").alias("source_id"))
    out.append(finding(links.join(gone, "source_id", "left_semi"), "links.deleted_source_has_outbound", name, **ids))
    return out


def columns_deleted(system: str = ":") -> Column:
    return F.col("path").startswith(system) | F.col("path").contains("/" + system)


def verify(
    store: Store,
    checks: Iterable[str] | None = None,
    repo_id: int | None = None,
    indexed: DataFrame | None = None,
) -> DataFrame:
    """All findings of the chosen check families or checks (all by default). Under a repository filter
    the checks of the whole store are left out."""
    families: dict[str, Callable[[], list[DataFrame]]] = {
        "chain": lambda: [*chain_checks(store.versions, store.documents), cycles(store.versions)],
        "hash": lambda: hash_checks(store.versions),
        "frontmatter": lambda: frontmatter_checks(store.versions),
    }
    if indexed is not None:
        families["fts"] = lambda: fts_checks(store.versions, indexed)
    if store.chunks is not None:
        chunks = store.chunks
        families["chunks"] = lambda: chunk_checks(store.versions, chunks, store.backlog)
    if store.links is not None:
        links = store.links
        families["links"] = lambda: link_checks(store.versions, links)
    chosen = set(checks) if checks is not None else set(families)
    parts = [p for name, make in families.items() if name in chosen or any(c.startswith(name + ".") for c in chosen) for p in make()]
    spark = store.versions.sparkSession
    found = reduce(DataFrame.unionByName, parts, spark.createDataFrame([], FINDING))
    if any("." in c for c in chosen):
        found = found.where(F.col("check").isin([c for c in chosen if "." in c]) | F.split_part("check", F.lit("."), F.lit(1)).isin(list(chosen)))
    if repo_id is not None:
        found = found.where((F.col("repo_id") == repo_id) & ~F.col("check").isin(*WHOLE_STORE))
    return found


def report(found: DataFrame, max_findings: int = 100, min_severity: str = "warn") -> dict:
    """Exact counts of all findings by check, and a bounded list of those at the bar or above."""
    counts = {(r["check"], r["severity"]): r["n"] for r in found.groupBy("check", "severity").agg(F.count(F.lit(1)).alias("n")).collect()}
    shown = found.where(F.col("severity") == "error") if min_severity == "error" else found
    order = [F.asc("check"), F.asc_nulls_first("repo_id"), F.asc_nulls_first("document_id"), F.asc_nulls_first("version_id")]
    rows = shown.orderBy(*order).limit(max_findings + 1).collect()
    return {"counts": counts, "findings": rows[:max_findings], "truncated": len(rows) > max_findings}

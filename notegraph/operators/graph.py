"""Bounded neighbourhoods of the link graph (GR1-GR10)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.errors import EngineError, filter_invalid
from notegraph.operators.store import Store
from notegraph.plans import cel
from notegraph.plans.compile import Tables, compile_filter
from notegraph.plans.visibility import Visibility, matches_any

# The bounds of one call.
MAX_DEGREES, DEFAULT_DOCUMENTS, MAX_DOCUMENTS, MAX_LINKS = 5, 100, 500, 5000


@dataclass(frozen=True)
class GraphSpec:
    roots: tuple[str, ...]
    degrees: int = 1
    direction: str = "out"  # out, in, both
    filter: str | None = None
    fields: tuple[str, ...] | None = None
    select: tuple[str, ...] = ("title",)
    max_documents: int = DEFAULT_DOCUMENTS
    visibility: Visibility = Visibility()


@dataclass(frozen=True)
class GraphResult:
    """``documents``: (document_id, path, degrees, selected keys, links, backlinks); ``links``: (source,
    target, field) by path; ``frontier``: (document_id, path) admitted but not fully expanded."""

    documents: DataFrame
    links: DataFrame
    frontier: DataFrame
    complete_degrees: int
    truncated: bool


def resolved(links: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """Resolved edges (source_id, target_id, field), repeats included: callers narrow them to the few
    documents at hand before they are made distinct."""
    found = links.where("target_id IS NOT NULL")
    if fields is not None:
        found = found.where(F.col("field").isin(list(fields)))
    return found.select("source_id", "target_id", "field")


def adjacency(links: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    return resolved(links, fields).distinct()


def steps(edges: DataFrame, direction: str) -> DataFrame:
    """(a, b): from where to where one step goes."""
    out = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    back = edges.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def expand(live: DataFrame, links: DataFrame, spec: GraphSpec) -> tuple[DataFrame, DataFrame, int, bool]:
    """(admitted (document_id, path, degrees), ids never fully expanded, complete degrees, truncated).

    A round takes the neighbours of the last ring that are visible and pass the filter with
    ``$degrees`` bound to the round; a document that fails is not passed through. Rings are admitted by
    path while the budget lasts; the admitted set is bounded by it, so it is planned as a local table.
    """
    if spec.direction not in ("out", "in", "both"):
        raise EngineError("unknown_arg", f"direction {spec.direction!r}")
    for name in spec.select:
        if name.startswith("$"):
            raise filter_invalid("graph selects front matter keys only")
    degrees = max(0, min(spec.degrees, MAX_DEGREES))
    budget = max(0, min(spec.max_documents, MAX_DOCUMENTS))
    tree = cel.parse(spec.filter) if spec.filter else None
    spark = live.sparkSession
    visible = live.where(spec.visibility.visible())
    step = steps(resolved(links, spec.fields), spec.direction)

    def passing(rows: DataFrame, r: int) -> DataFrame:
        if tree is None:
            return rows
        return compile_filter(cel.bind(tree, "$degrees", r), Tables(live, links, spec.visibility)).apply(rows)

    admitted: list[tuple[int, str, int]] = []
    schema = "document_id long, path string, degrees int"
    roots = [p.removeprefix("/") if "*" not in p else p for p in spec.roots]
    exact = [p for p in roots if "*" not in p]
    globs = [p for p in roots if "*" in p]
    rooted = visible.where(F.col("path").isin(exact) | matches_any(F.col("path"), globs))
    ring_rows = passing(rooted, 0)
    complete, truncated, open_ids = degrees, False, []
    for r in range(degrees + 1):
        left = budget - len(admitted)
        # One more than fits tells whether the ring was cut.
        ring = ring_rows.select("document_id", "path").orderBy("path", "document_id").limit(left + 1).collect()
        if len(ring) > left:
            truncated, complete = True, max(0, r - 1)
            open_ids = [d for d, _, deg in admitted if deg == r - 1]
            ring = ring[:left]
        admitted += [(x.document_id, x.path, r) for x in ring]
        if truncated or not ring or r == degrees:
            break
        last = spark.createDataFrame([(x.document_id,) for x in ring], "a long")
        seen = spark.createDataFrame([(d,) for d, _, _ in admitted], "document_id long")
        reached = (
            step.join(F.broadcast(last), "a", "left_semi").select(F.col("b").alias("document_id")).distinct()
        )
        fresh = reached.join(F.broadcast(seen), "document_id", "left_anti")
        ring_rows = passing(visible.join(fresh, "document_id", "left_semi"), r + 1)
    if not admitted:
        complete = 0
    top = max((deg for _, _, deg in admitted), default=0)
    if truncated or top == degrees:
        open_ids += [d for d, _, deg in admitted if deg == top]
    return (
        spark.createDataFrame(admitted, schema),
        spark.createDataFrame([(d,) for d in sorted(set(open_ids))], "document_id long"),
        complete,
        truncated,
    )


def degree_counts(live: DataFrame, links: DataFrame, visibility: Visibility, only: DataFrame | None = None) -> DataFrame:
    """(document_id, links, backlinks): distinct visible documents at the other end, scope alone. With
    ``only``, of these few documents."""
    seen = live.where(visibility.visible()).select("document_id")
    edges = resolved(links).select("source_id", "target_id")

    def side(own: str, other: str, name: str) -> DataFrame:
        mine = edges
        if only is not None:
            mine = mine.join(F.broadcast(only.select(F.col("document_id").alias(own))), own, "left_semi")
        mine = mine.distinct()
        # The few documents asked for are visible themselves.
        for end in (own, other) if only is None else (other,):
            mine = mine.join(seen.withColumnRenamed("document_id", end), end, "left_semi")
        return mine.groupBy(F.col(own).alias("document_id")).agg(F.count(F.lit(1)).alias(name))

    out = side("source_id", "target_id", "links")
    back = side("target_id", "source_id", "backlinks")
    return out.join(back, "document_id", "full_outer").na.fill(0, ["links", "backlinks"])


def induced(admitted: DataFrame, links: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """Distinct edges with both ends admitted, whatever the direction of the walk."""
    ends = admitted.select("document_id", "path")
    source = ends.select(F.col("document_id").alias("source_id"), F.col("path").alias("source"))
    target = ends.select(F.col("document_id").alias("target_id"), F.col("path").alias("target"))
    found = resolved(links, fields).join(F.broadcast(source), "source_id").join(F.broadcast(target), "target_id")
    return found.select("source", "target", "field").distinct()


def frontier(admitted: DataFrame, open_ids: DataFrame, live: DataFrame, links: DataFrame, spec: GraphSpec) -> DataFrame:
    """Admitted documents with a neighbour in the walk's direction that is readable and not admitted."""
    seen = live.where(spec.visibility.visible()).select(F.col("document_id").alias("b"))
    out = steps(resolved(links, spec.fields), spec.direction)
    out = out.join(F.broadcast(open_ids.withColumnRenamed("document_id", "a")), "a", "left_semi")
    out = out.join(F.broadcast(admitted.select(F.col("document_id").alias("b"))), "b", "left_anti")
    beyond = out.distinct().join(seen, "b", "left_semi").select(F.col("a").alias("document_id")).distinct()
    return admitted.select("document_id", "path").join(beyond, "document_id", "left_semi")


def graph(store: Store, spec: GraphSpec, live: DataFrame | None = None) -> GraphResult:
    live = store.live if live is None else live
    assert store.links is not None
    links = store.links
    admitted, open_ids, complete, truncated = expand(live, links, spec)
    keys = [
        F.try_variant_get("frontmatter", "$" + "".join(f'["{f}"]' for f in k.split(".")), "variant").alias(k)
        for k in spec.select
    ]
    rows = live.join(F.broadcast(admitted.select("document_id", "degrees")), "document_id").select(
        "document_id", "path", "degrees", *keys
    )
    counted = degree_counts(live, links, spec.visibility, admitted)
    documents = (
        rows.join(counted, "document_id", "left").na.fill(0, ["links", "backlinks"]).orderBy("degrees", "path")
    )
    edges = induced(admitted, links, spec.fields).orderBy("source", "target", "field").limit(MAX_LINKS)
    open_ = frontier(admitted, open_ids, live, links, spec).orderBy("path")
    return GraphResult(documents, edges, open_, complete, truncated)

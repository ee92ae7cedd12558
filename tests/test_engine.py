"""Operators over a small collection: query, search, graph, history, writes, links, scrub."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from notegraph import catalog
from notegraph.config import LinkConfig, PathConfig, Syntaxes
from notegraph.errors import EngineError
from notegraph.operators import fulltext, graph, guard, history, links, query, snapshots, store, sync, vectors, verify, worker, writes
from notegraph.operators.query import QuerySpec
from notegraph.operators.store import live
from notegraph.plans.visibility import Claim, Visibility, allows
from tests.vault import FILES, ids, nothing, vault


@pytest.fixture(scope="module")
def base(spark):
    return vault(spark)


def paths(df):
    return sorted(r[0] for r in df.collect())


def ask(base, **spec):
    return [h["$path"] for h in query.hits(query.run_query(base, QuerySpec(**spec)))]


def test_default_query(base):
    assert ask(base) == ["lone.md", "leaf.md", "notes/mid.md", "moc/index.md"]
    assert "notes/.hidden.md" in ask(base, visibility=Visibility(include_hidden=True))
    assert ask(base, limit=2) == ["lone.md", "leaf.md"] and ask(base, limit=0) == []


def test_projection_leaves_out_missing_keys(base):
    got = query.hits(query.run_query(base, QuerySpec(select=("$path", "title", "tags", "$version_id"))))
    by = {h["$path"]: h for h in got}
    assert by["notes/mid.md"] == {"$path": "notes/mid.md", "title": "Mid", "tags": ["a", "b"], "$version_id": "v2"}
    assert "title" not in by["lone.md"]
    assert query.etag(got) == query.etag(list(got)) and len(query.etag(got)) == 16


def test_text_modes(base):
    assert sorted(ask(base, text="fox jump")) == ["leaf.md", "notes/mid.md"]
    assert ask(base, text='"quick fox"') == ["notes/mid.md"]
    assert ask(base, text="fox", filter='title == "Leaf"') == ["leaf.md"]
    assert sorted(ask(base, text="missing OR over")) == ["leaf.md", "moc/index.md"]
    assert ask(base, text='"') == [] and ask(base, text="") == []


def test_scope(base):
    assert ask(base, visibility=Visibility(claims=())) == []
    seen = Visibility(claims=(Claim(globs=("notes/**",)), Claim(globs=("**", "!moc/**", "!notes/**", "!lone.md"))))
    assert ask(base, visibility=seen) == ["leaf.md", "notes/mid.md"]


@pytest.mark.parametrize("spec", [{"limit": -1}, {"select": ("$nope",)}, {"select": ()}, {"semantic": ()}, {"select": ("$semantic_score",)}])
def test_bad_specs(base, spec):
    with pytest.raises(EngineError) as e:
        query.run_query(base, QuerySpec(**spec))
    assert e.value.code == "filter_invalid"


def test_semantic(spark, base):
    now = ids(base.versions)
    rows = [(now["leaf.md"], 0, "t", "h", "m", [1.0, 0.0, 0.0]), (now["lone.md"], 0, "t", "h", "m", [0.0, 1.0, 0.0]), (now["lone.md"], 1, "t", "h", "m", [0.9, 0.1, 0.0])]
    own = base.with_(chunks=spark.createDataFrame(rows, store.CHUNK_SCHEMA))
    got = query.hits(query.run_query(own, QuerySpec(semantic=(0.0, 1.0, 0.0), select=("$path", "$semantic_score"))))
    assert [h["$path"] for h in got] == ["lone.md", "leaf.md"] and got[0]["$semantic_score"] == pytest.approx(1.0)
    with pytest.raises(EngineError):
        query.run_query(base, QuerySpec(semantic=(1.0,)))
    assert vectors.candidates(10) == 40 and vectors.candidates(100) == 200


def test_embedding_reuses_texts(spark, base):
    calls = spark.sparkContext.accumulator(0)

    def embedder(texts):
        calls.add(len(texts))
        return vectors.hash_embedder(4)(texts)

    cut = vectors.chunked(live(base.versions))
    done = vectors.embed(cut, spark.createDataFrame([], store.CHUNK_SCHEMA), embedder, "hash")
    done = spark.createDataFrame(done.collect(), done.schema)
    assert done.count() == cut.count() and calls.value == cut.select("text_hash").distinct().count()
    again = vectors.embed(cut, done, embedder, "hash")
    assert again.count() == cut.count() and calls.value == cut.select("text_hash").distinct().count()
    assert vectors.unembedded(live(base.versions), done).count() == 0
    with pytest.raises(EngineError):
        vectors.check_vectors("m", [[1.0], [1.0, 2.0]], 2)
    mixed = spark.createDataFrame([(1, 0, "t", "h", "m", [1.0]), (1, 1, "t", "h", "m", [1.0, 2.0])], store.CHUNK_SCHEMA)
    with pytest.raises(EngineError):
        vectors.upsert_chunks(done, mixed)


def test_links_of_the_vault(base):
    got = {(r.source_id, r.field, r.target_norm, r.target_id) for r in base.links.collect()}
    at = {r.path: r.document_id for r in live(base.versions).collect()}
    assert got == {
        (at["moc/index.md"], "$body", "notes/mid.md", at["notes/mid.md"]),
        (at["moc/index.md"], "$body", "leaf.md", at["leaf.md"]),
        (at["moc/index.md"], "$body", "moc/gone.md", None),
        (at["notes/mid.md"], "$body", "moc/index.md", at["moc/index.md"]),
        (at["leaf.md"], "related", "notes/mid.md", at["notes/mid.md"]),
        (at["notes/.hidden.md"], "$body", "notes/mid.md", at["notes/mid.md"]),
    }


def test_graph_filters(base):
    assert ask(base, filter='$in("moc/*")') == ["leaf.md", "notes/mid.md"]
    assert ask(base, filter='$has("gone.md")') == ["moc/index.md"]
    assert ask(base, filter='!$in("**")') == ["lone.md"]
    assert ask(base, filter='$in("leaf.md", "related")') == ["notes/mid.md"]
    # The hidden document's link does not count.
    assert ask(base, filter="$backlinks().size() == 2") == ["notes/mid.md"]
    assert ask(base, filter="$links().size() == 3") == ["moc/index.md"]
    assert ask(base, filter='$links().exists(l, l.title == "Leaf" && title == "Index")') == ["moc/index.md"]
    assert ask(base, filter='$links().all(l, l.title == "Mid")') == ["lone.md", "leaf.md"]


def test_graph_walk(base):
    got = graph.graph(base, graph.GraphSpec(("/moc/index.md",), 2, "out"))
    assert [(r.path, r.degrees, r.links, r.backlinks) for r in got.documents.collect()] == [("moc/index.md", 0, 2, 1), ("leaf.md", 1, 1, 1), ("notes/mid.md", 1, 1, 2)]
    assert (got.complete_degrees, got.truncated) == (2, False) and got.frontier.count() == 0
    assert len(got.links.collect()) == 4
    one = graph.graph(base, graph.GraphSpec(("leaf.md",), 1, "out"))
    assert paths(one.documents.select("path")) == ["leaf.md", "notes/mid.md"] and paths(one.frontier.select("path")) == ["notes/mid.md"]
    cut = graph.graph(base, graph.GraphSpec(("moc/index.md",), 3, "both", max_documents=2))
    assert cut.truncated and cut.complete_degrees == 0 and cut.documents.count() == 2
    blocked = graph.graph(base, graph.GraphSpec(("leaf.md",), 5, "out", filter='$degrees == 0 || title != "Mid"'))
    assert paths(blocked.documents.select("path")) == ["leaf.md"]
    none = graph.graph(base, graph.GraphSpec(("nowhere/**",), 2))
    assert none.documents.count() == 0 and none.complete_degrees == 0 and not none.truncated
    assert graph.graph(base, graph.GraphSpec(("leaf.md",), 999)).complete_degrees == graph.MAX_DEGREES
    for bad in (graph.GraphSpec(("x",), select=("$path",)), graph.GraphSpec(("x",), direction="up")):
        with pytest.raises(EngineError):
            graph.graph(base, bad)


def test_writes(spark, base):
    v, (a,) = writes.apply(base.versions, 1, [writes.Op("put", "LEAF.md", "new", raw="t: 1\n$version: v9\n", prev=ids(base.versions)["leaf.md"])])
    row = writes.get(live(v), 1, "/leaf.md")
    assert (row.id, row.body, row.frontmatter_raw, row.path) == (a, "new", "t: 1\n", "leaf.md")
    v2, ids2 = writes.apply(v, 1, [writes.Op("put", "leaf.md", "moved", prev=a, new_path="x/leaf.md"), writes.Op("create", "leaf.md", "again", frontmatter={"k": 1})])
    assert writes.get(live(v2), 1, "x/leaf.md").id == ids2[0] and writes.get(live(v2), 1, "leaf.md").frontmatter_raw == "k: 1\n"
    for op, code in [
        (writes.Op("create", "leaf.md"), "create_conflict"),
        (writes.Op("put", "leaf.md", prev=1), "stale_prev"),
        (writes.Op("put", "nope.md", prev=1), "doc_not_found"),
        (writes.Op("put", "lone.md", prev=ids(v2)["lone.md"], new_path="Leaf.md"), "path_taken"),
        (writes.Op("create", "a//b"), "path_invalid"),
        (writes.Op("create", "new.md", raw="a: [", frontmatter=None), "frontmatter_invalid"),
        (writes.Op("create", "new.md", raw="a: 1", frontmatter={}), "frontmatter_invalid"),
        (writes.Op("delete", "nope.md"), "doc_not_found"),
    ]:
        with pytest.raises(EngineError) as e:
            writes.apply(v2, 1, [op])
        assert e.value.code == code
    v3, (gone,) = writes.apply(v2, 1, [writes.Op("delete", "lone.md")])
    assert any(r.path.startswith(":deleted/lone-v") for r in live(v3).select("path").collect())
    assert writes.apply(v3, 1, [writes.Op("delete", "lone.md")])[1] == [ids(base.versions)["lone.md"]]
    many = writes.get_many(live(v3), 1, ["/leaf.md", "LEAF.md", "nope.md", "a//b"])
    assert many["/leaf.md"] == many["LEAF.md"] and many["nope.md"].code == "doc_not_found" and many["a//b"].code == "path_invalid"
    v4, _ = writes.append(v3, 1, "leaf.md", "more")
    assert writes.get(live(v4), 1, "leaf.md").body == "again\nmore"
    with pytest.raises(EngineError):
        writes.append(v4, 1, "leaf.md", "")
    assert writes.get_version(v4, f"v{a}").body == "new"
    for ref in ("v99999", "x1", f"v{a}"):
        with pytest.raises(EngineError):
            writes.get_version(v4, ref, repo=2)


def test_snapshots(spark, base, tmp_path):
    root = str(tmp_path)
    with pytest.raises(EngineError):
        snapshots.open_snapshot(spark, root)
    assert snapshots.commit({"versions": base.versions, "links": base.links}, root, 0) == 1
    assert snapshots.commit({"versions": base.versions.where("id > 2"), "links": base.links}, root) == 2
    got = snapshots.open_snapshot(spark, root)
    assert got["versions"].count() == len(FILES) - 2 and got["links"].count() == base.links.count()
    assert snapshots.open_snapshot(spark, root, 1)["versions"].count() == len(FILES)
    with pytest.raises(EngineError) as e:
        snapshots.commit({"links": base.links}, root, 1)
    assert e.value.code == "stale_prev" and e.value.detail == {"current": 2}
    snapshots.prune(spark, root)
    assert snapshots.open_snapshot(spark, root)["versions"].count() == len(FILES) - 2 and snapshots.head(spark, root) == 2


def test_transactions(spark, base, tmp_path):
    root = str(tmp_path)
    with snapshots.transaction(spark, root) as t:
        t.tables["versions"] = base.versions
        with pytest.raises(ValueError), t.savepoint():
            t.tables["versions"] = base.versions.where("id > 2")
            raise ValueError
    assert snapshots.open_snapshot(spark, root)["versions"].count() == len(FILES)
    with pytest.raises(ValueError), snapshots.transaction(spark, root) as t:
        t.tables["links"] = base.links
        raise ValueError
    with pytest.raises(EngineError) as e, snapshots.transaction(spark, root) as t:
        t.tables["links"] = base.links
        with snapshots.transaction(spark, root) as faster:
            faster.tables["versions"] = base.versions.where("id > 3")
    assert e.value.code == "stale_prev" and snapshots.head(spark, root) == 2
    assert list(snapshots.open_snapshot(spark, root)) == ["versions"]


def test_repos(spark):
    r = writes.Repos([])
    r.create("alpha")
    r.create("beta")
    for bad, code in (("Alpha", "slug_taken"), ("a/b", "slug_invalid"), (":x", "slug_invalid"), ("x" * 65, "slug_invalid")):
        with pytest.raises(EngineError) as e:
            r.create(bad)
        assert e.value.code == code
    r.rename("alpha", "gamma")
    r.delete("beta")
    assert query.resolve_repos(r.frame(spark), ("*",)) == [1]
    assert query.resolve_repos(r.frame(spark), (":deleted*",)) == []
    with pytest.raises(EngineError):
        query.resolve_repos(r.frame(spark), ("beta",))


def chained(spark):
    v = nothing(spark)
    v, (a,) = writes.apply(v, 1, [writes.Op("create", "a.md", "1")], "2026-01-01T00:00:00.000Z")
    v, (b,) = writes.apply(v, 1, [writes.Op("put", "a.md", "2", prev=a)], "2026-01-01T00:00:05.000Z")
    v, (c,) = writes.apply(v, 1, [writes.Op("put", "a.md", "3", prev=b, new_path="b.md")], "2025-01-01T00:00:00.000Z")
    v, (d,) = writes.apply(v, 1, [writes.Op("delete", "b.md")], "2026-01-01T00:00:09.000Z")
    return spark.createDataFrame(v.collect(), v.schema), (a, b, c, d)


def test_history(spark):
    v, (a, b, c, d) = chained(spark)
    assert [r.id for r in history.chain(v, d).collect()] == [d, c, b, a]
    assert [r.id for r in history.chain(v, d, before=c).collect()] == [b, a]
    assert [r.id for r in history.chain(v, d, limit=2).collect()] == [d, c]
    assert history.chain(v, 999).count() == 0
    assert [r.op for r in history.refs(v).orderBy("id").collect()] == ["create", "update", "move", "delete"]
    assert {r.id: r.depth for r in history.depths(v).collect()} == {a: 0, b: 1, c: 2, d: 3}
    assert [r.id for r in history.listing(v, ("a.md",), ever=True).collect()] == [c, b, a]
    assert history.listing(v, ("a.md",)).count() == 0
    assert {r.id: r.next_id for r in store.with_next(v).collect()} == {a: b, b: c, c: d, d: None}
    assert [r.id for r in history.index(v, c).collect()] == [c]
    assert sync.net_effect(history.refs(v).where(F.col("id") > a)).first().op == "delete"


def log(spark, rows):
    got = [(i, f"2026-01-01T00:{m:02d}:{s:02d}.000Z") for i, m, s in rows]
    return spark.createDataFrame(got, "id long, created_at string")


NOW = 1767226200000  # 2026-01-01T00:10:00Z


@pytest.mark.parametrize(
    ("rows", "after", "want"),
    [
        ([(1, 0, 0), (2, 0, 1), (3, 9, 59)], 0, 3),
        ([(1, 0, 0), (3, 9, 59)], 0, 1),
        ([(1, 0, 0), (3, 1, 0), (4, 9, 59)], 0, 4),
        ([(2, 9, 59)], 0, 0),
        ([(5, 0, 0)], 4, 5),
        ([], 7, 7),
        ([(1, 0, 0), (3, 9, 30), (5, 9, 31)], 0, 3),
    ],
)
def test_safe_frontier(spark, rows, after, want):
    assert history.safe_upper(log(spark, rows), after, NOW) == want


def test_frontier_beyond_one_scan(spark):
    """Without a scan bound the frontier is that of the whole log, and a page given it stays a page."""
    rows = log(spark, [(i, 0, 0) for i in range(1, 21) if i != 5] + [(22, 9, 59), (30, 0, 0)])
    assert history.safe_upper(rows, 0, NOW, scan=10) == 11
    assert history.safe_upper(rows, 0, NOW, scan=None) == 20


def test_since_gap_tells_the_frontier_behind_a_full_page(spark, tmp_path):
    """The log is so long that the page ends before the frontier."""
    at = "TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * range"
    duckdb.sql(f"COPY (SELECT range AS event_id, {at} AS ts, range % 50 AS user_id, 'view' AS event_type, 1.0 AS value, '{{}}' AS props FROM range(40000)) TO '{tmp_path}/events.parquet'")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.sql(catalog.oracle_sql()["hs_since_gap"]).fetchall()
    assert [tuple(r) for r in catalog.queries()["hs_since_gap"](spark, str(tmp_path)).orderBy("id").collect()] == want
    assert len(want) == 500 and want[0][2] > want[-1][0]


def test_safe_head(spark):
    assert history.safe_head(log(spark, [(10, 0, 0), (11, 0, 0), (13, 9, 59)]), NOW) == 11
    assert history.safe_head(log(spark, []), NOW) == 0


def test_link_syntax():
    got = lambda body, **c: [(e.target, e.wiki) for e in links.extract(body, {}, links.LinkConfig(body=links.Syntaxes(**c)))]
    assert got("[a](b.md) ![i](c.png 'T') [d](<e f.md>)") == [("b.md", False), ("c.png", False), ("e f.md", False)]
    assert got("`[a](b.md)` ``x ` [c](d.md)`` [e](f.md)") == [("f.md", False)]
    assert got("```\n[a](b.md)\n```\n\n    [c](d.md)\n\n[e](f(1).md)") == [("f(1).md", False)]
    assert got("[a][ref] [ref] [Ref][] [no]\n\n[ref]: /x.md 'T'") == [("/x.md", False)]
    assert got("[[p|shown]] ![[q#h]] [[ ]]") == [("p", True), ("q#h", True)]
    assert got("see /a/b.md and (/c.md#x) http://x/y.md") == [("/a/b.md", False), ("/c.md#x", False)]
    assert got(r"\[a](b.md) [x\]](c.md)") == [("c.md", False)]
    assert got("[[p]] [a](b.md) /c.md", wikilink=False, inline=False, fullpath=False) == []
    assert [(e.field, e.target) for e in links.extract("", {"a": ["/x.md", {"b": "[[y]] and [z](w.md)"}], "n": 3})] == [("a", "/x.md"), ("a.b", "y"), ("a.b", "w.md")]


@pytest.mark.parametrize(
    ("target", "wiki", "want"),
    [
        ("b.md", False, ("d/b.md", ["d/b.md"])), ("../b.md#s", False, ("b.md#s", ["b.md"])), ("/x/./y.md", False, ("x/y.md", ["x/y.md"])),
        ("../../b.md", False, ("../../b.md", [])), ("#s", False, ("#s", [])), ("https://x.y/z", False, ("https://x.y/z", [])),
        ("p", True, ("p.md", ["p.md", "p/index.md"])), ("/p.md", True, ("p.md", ["p.md"])), ("2024.01.01#h", True, ("2024.01.01.md#h", ["2024.01.01.md", "2024.01.01/index.md"])),
    ],
)
def test_targets(target, wiki, want):
    assert links.targets(links.Edge("$body", target, wiki), "d/s.md") == want


def test_stale_and_repair(base):
    v, _ = writes.apply(base.versions, 1, [writes.Op("put", "notes/mid.md", FILES["notes/mid.md"][1], raw="title: Mid\n", prev=ids(base.versions)["notes/mid.md"], new_path="far/mid2.md")])
    now = live(v)
    got = links.stale(base.links, now)
    assert sorted(r.field for r in got.collect()) == ["$body", "$body", "related"] and {r.current_path for r in got.collect()} == {"far/mid2.md"}
    bodies = {r.path: r.body for r in links.repair(now, base.links).collect()}
    assert bodies["moc/index.md"] == "See [mid](/far/mid2.md), [[leaf]] and [missing](gone.md)."
    assert links.repaired("[[old#x|o]]", [{"start": 2, "end": 7, "wiki": True, "current_path": "new/p.md"}]) == "[[new/p#x|o]]"


def test_danglers_bind(base):
    v, _ = writes.apply(base.versions, 1, [writes.Op("create", "moc/gone.md", "here now")])
    bound = links.bind_danglers(base.links, live(v))
    assert bound.where("target_id IS NULL").count() == 0


def test_scrub_of_a_sound_store(spark, base):
    indexed = fulltext.tokens(base.versions)
    owners = base.versions.select("document_id", "repo_id").distinct()
    assert verify.verify(base.with_(documents=owners), indexed=indexed).collect() == []
    assert verify.report(verify.verify(base), 10) == {"counts": {}, "findings": [], "truncated": False}


def test_scrub_finds_faults(spark, base):
    v = base.versions.withColumn("content_hash", F.when(F.col("id") == 1, "bad").when(F.col("id") == 2, None).otherwise(F.col("content_hash")))
    v = v.withColumn("frontmatter_raw", F.when(F.col("id") == 3, "a: [").when(F.col("id") == 4, "title: Other\n").otherwise(F.col("frontmatter_raw")))
    owners = v.select("document_id", F.lit(2).cast("long").alias("repo_id")).distinct().unionByName(spark.createDataFrame([(99, 1)], "document_id long, repo_id long"))
    bad_links = base.links.withColumn("target_id", F.when(F.col("target_norm") == "leaf.md", None).otherwise(F.col("target_id")))
    found = verify.verify(base.with_(versions=v, documents=owners, links=bad_links))
    names = {r.check for r in found.collect()}
    assert {"hash.mismatch", "hash.missing", "frontmatter.parse_error", "frontmatter.divergence", "chain.orphan_document", "chain.repo_mismatch", "links.misresolved_dangling"} <= names
    got = verify.report(found, 2, "error")
    assert got["truncated"] and len(got["findings"]) == 2 and got["counts"][("hash.missing", "warn")] == 1
    only = verify.verify(base.with_(versions=v, documents=owners), ["hash.missing"])
    assert {r.check for r in only.collect()} == {"hash.missing"}


def test_cycles(spark):
    rows = [(1, 1, 1, 3, None, "a"), (2, 1, 1, 1, 3, "a"), (3, 1, 1, 2, 1, "a"), (4, 2, 1, None, 5, "b"), (5, 2, 1, 4, None, "b"), (6, 3, 1, 7, 7, "c"), (7, 3, 1, 6, 6, "c")]
    v = spark.createDataFrame(rows, "id long, document_id long, repo_id long, prev_id long, next_id long, path string")
    assert [r.document_id for r in verify.cycles(v).collect()] == [1]
    # A cycle without a current version shows as such only.
    none = [f for f in verify.chain_checks(v, None)]
    assert any(r.check == "chain.no_current" and r.document_id == 3 for f in none for r in f.collect())


def test_inbound(spark):
    rows = [("a", 2, "h2", 2, "h2", "h2", False), ("b", 2, "h2", 1, "h2", "h1", False), ("c", 2, "h2", 1, "h1", "h1", False), ("d", 2, "h2", 1, "x", "h1", False), ("e", 2, "h2", 1, "x", "h1", True), ("f", 2, "h2", None, None, None, False)]
    df = spark.createDataFrame(rows, "path string, ref_version long, ref_hash string, file_version long, file_hash string, stamped_hash string, hot boolean")
    assert [r.decision for r in sync.inbound(df).orderBy("path").collect()] == ["noop", "adopt", "materialize", "rebase", "defer", "materialize"]


def test_backlog(spark):
    old = spark.createDataFrame([(1, 2, "e", "2026-01-01"), (2, 0, None, None)], store.BACKLOG_SCHEMA)
    new = spark.createDataFrame([(1, 0, None, None), (3, 1, "x", "2026-01-03")], store.BACKLOG_SCHEMA)
    both = writes.enqueue(old, new)
    assert [r.version_id for r in writes.dequeue(both, "2026-01-02", 9).collect()] == [1, 2]
    assert tuple(writes.backlog_status(both, "2026-01-02").first()) == (3, 2, 1, "2026-01-03")
    assert [r.version_id for r in writes.last_errors(both).collect()] == [3]


def test_cleared_links_and_totals(spark, base):
    gone = spark.createDataFrame([(base.links.first().source_id,)], "document_id long")
    left = links.cleared(base.links, gone)
    assert left.count() < base.links.count() and left.join(gone, left.source_id == gone.document_id).count() == 0
    assert tuple(links.totals(base.links).first()) == (4, 6, 1)


def test_path_warnings(base):
    config = PathConfig(disallowed_chars=("x",), system_sigils=(":", "no"))
    got = {r.path: r.reason for r in writes.path_warnings(live(base.versions), config).collect()}
    assert got == {"moc/index.md": "character x"}


def test_derived_tables_give_the_same(base):
    own = base.with_(current=base.live, indexed=fulltext.tokens(base.versions))
    for spec in ({}, {"text": "fox jump"}, {"text": '"quick fox"', "filter": 'title == "Mid"'}):
        assert ask(own, **spec) == ask(base, **spec)


def test_live_rows_advance_with_the_log(spark):
    v, (a, b, c, d) = chained(spark)
    current = live(v.where(F.col("id") <= b))
    assert [r.id for r in store.advanced(current, v.where(F.col("id") > b)).collect()] == [d]
    assert [r.id for r in store.advanced(current, v.where(F.col("id") == c)).collect()] == [c]


@pytest.mark.parametrize(
    ("glob", "yes", "no"),
    [
        ("/f?o.md", ["foo.md", "f1o.md"], ["fo.md", "fooo.md", "f/o.md", "a/foo.md"]),
        ("doc?.md", ["doc1.md", "a/b/docx.md"], ["doc.md", "doc12.md", "doc/.md"]),
        ("a/?/b", ["a/x/b"], ["a//b", "a/xy/b", "z/a/x/b"]),
        ("notes/**", ["notes/a", "notes/a/b.md"], ["notes", "x/notes/a"]),
        ("**/x.md", ["x.md", "a/x.md", "a/b/x.md"], ["ax.md"]),
        ("a/*.md", ["a/b.md", "a/.md"], ["a/b/c.md", "a/bxmd"]),
        ("**", ["a", "a/b"], []),
        ("a+(b)[c].md", ["a+(b)[c].md"], ["aab.md"]),
    ],
)
def test_every_sign_of_a_glob(spark, glob, yes, no):
    from pyspark.sql import functions as F

    from notegraph.plans.visibility import glob_to_regex

    rows = spark.createDataFrame([(x,) for x in yes + no], "path string")
    assert {x.path for x in rows.where(F.col("path").rlike(glob_to_regex(glob))).collect()} == set(yes)


def test_written_paths_and_wikilinks():
    from notegraph.operators.links import extract

    body = "see /a/b.md, (/c.md#top) and /d.md.txt or x/e.md [[ Page one |label]] ![[img]] [[]] [[two\nlines]] `[[code]]` /f.txt /.md \"/g.md\""
    assert [(e.target, e.wiki) for e in extract(body, {})] == [
        ("/a/b.md", False), ("/c.md#top", False), ("/d.md", False), ("Page one", True), ("img", True), ("/g.md", False),
    ]
    assert [e.target for e in extract("", {"k": " /x/y.md#z ", "l": ["/not a path.md", "/h.md"]})][0] == "/x/y.md#z"


def test_links_of_long_texts_take_no_long():
    from notegraph.operators.links import extract

    assert len(extract("`code` [[page]] [a](b.md) /p.md\n" * 20_000, {})) == 60_000
    extract("[[" * 50_000 + "]", {})
    extract("(/" * 50_000, {})


def test_lanes_past_the_digest_differ():
    from notegraph.operators.vectors import hash_embedder

    _, [v] = hash_embedder(96)(["text"])
    assert v[:32] != v[32:64] != v[64:] and abs(sum(x * x for x in v) - 1) < 1e-9


def embedders(spark):
    calls = spark.sparkContext.accumulator(0)

    def named(model):
        def embed(texts):
            calls.add(len(texts))
            if any("fails" in t for t in texts):
                raise RuntimeError("no answer " * 100)
            return model, vectors.hash_embedder(4)(texts)[1]

        return embed

    return calls, named


def test_worker_drains_the_backlog(spark):
    calls, named = embedders(spark)
    two = "one text\n\n## Head\n\n" + "long " * 500
    v, made = writes.apply(nothing(spark), 1, [writes.Op("create", "a.md", two), writes.Op("create", "b.md", "fails here"), writes.Op("create", "c.md", " ")])
    v, (later,) = writes.apply(v, 1, [writes.Op("put", "a.md", two + "\n\n## More\n\nnew", prev=made[0])])
    v = spark.createDataFrame(v.collect(), v.schema)
    empty = spark.createDataFrame([], store.CHUNK_SCHEMA)
    waiting = spark.createDataFrame([(made[0], 0, None, None), (made[1], 2, "e", "2026-01-01T00:00:00.000Z"), (made[2], 0, None, None), (later, 0, None, "2027-01-01T00:00:00.000Z")], store.BACKLOG_SCHEMA)
    got = worker.drain(live(v), empty, waiting, named("m"), "2026-01-02T00:00:00.000Z")
    assert {r.version_id: r.outcome for r in got.outcomes.collect()} == {made[0]: "skipped", made[1]: "failed", made[2]: "processed"}
    left = {r.version_id: r for r in got.backlog.collect()}
    assert set(left) == {made[1], later} and left[later].attempts == 0
    again = left[made[1]]
    assert (again.attempts, again.next_retry_at, len(again.last_error)) == (3, "2026-01-02T00:02:00.000Z", 500)
    assert got.chunks.count() == 0

    # What the predecessor has is reused; only the new text goes to the embedder.
    old = vectors.chunked(live(v.where(F.col("id") <= made[2])).where(F.col("id") == made[0]))
    old = vectors.embed(old, empty, vectors.hash_embedder(4), "m")
    old = spark.createDataFrame(old.collect(), old.schema)
    before = calls.value
    rest = got.backlog.where(F.col("version_id") == later)
    now = worker.drain(live(v), old, rest, named("m"), "2027-01-02T00:00:00.000Z", 1)
    fresh = now.chunks.where(F.col("version_id") == later)
    assert fresh.count() == old.count() + 1 and calls.value == before + 1
    assert now.backlog.count() == 0 and now.chunks.count() == fresh.count() + old.count()

    # An answer of another model embeds every text again.
    other = worker.drain(live(v), old, rest, named("n"), "2027-01-02T00:00:00.000Z")
    assert {r.model for r in other.chunks.where(F.col("version_id") == later).collect()} == {"n"} and other.backlog.count() == 0


def test_retry_times(spark):
    rows = spark.createDataFrame([(n,) for n in range(1, 12)], "n int")
    got = [r[0] for r in rows.orderBy("n").select(history.retry_at("2026-01-01T00:00:00.000Z", F.col("n"))).collect()]
    assert got[:3] == ["2026-01-01T00:00:30.000Z", "2026-01-01T00:01:00.000Z", "2026-01-01T00:02:00.000Z"]
    assert got[6] == "2026-01-01T00:32:00.000Z" and set(got[7:]) == {"2026-01-01T01:00:00.000Z"}


def test_pushes_put_before_deletes_and_know_renames(spark):
    burst = spark.createDataFrame([("new.md",), ("old.md",), ("gone.md",), ("never.md",), ("edit.md",), ("old.md",)], "path string")
    local = spark.createDataFrame([("new.md", 5), ("edit.md", 7), ("else.md", 9)], "path string, version_id long")
    known = spark.createDataFrame([("old.md", 5), ("gone.md", 9), ("edit.md", 7)], "path string, version_id long")
    got = {r.path: (r.action, r.version_id, r.turn) for r in sync.pushes(burst, local, known).collect()}
    assert got == {"new.md": ("put", 5, 0), "edit.md": ("put", 7, 0), "old.md": ("moved", 5, 1), "gone.md": ("delete", 9, 1), "never.md": ("untracked", None, 1)}


def test_a_feed_page_does_not_shuffle_the_log(spark, base):
    page, _ = history.feed(base.versions, 0, 10**15)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def test_path_configuration_in_layers(spark, base):
    server = PathConfig(hidden_sigils=("_",))
    own = server.layered('{"system_sigils": ["@", "sys-"], "hidden_sigils": null, "other": 1}')
    assert own == PathConfig(system_sigils=("@", "sys-"), hidden_sigils=("_",)) and server.layered(None) == server == server.layered("null")
    for bad in ({"system_sigils": []}, {"hidden_sigils": [":h"]}, {"hidden_sigils": ["a/"]}, {"disallowed_chars": ["ab"]}, {"system_sigils": ["."]}, {"hidden_sigils": ["|"]}, {"hidden_sigils": "."}, []):
        with pytest.raises(EngineError):
            PathConfig().layered(json.dumps(bad))
    repos = writes.Repos([])
    repos.create("one")
    repos.configure("one", path_config={"hidden_sigils": ["no", "l"]})
    with pytest.raises(EngineError):
        repos.configure("one", path_config={"hidden_sigils": [""]}, link_config=None)
    assert ask(base, visibility=repos.visibility()) == ["moc/index.md"]
    assert repos.paths("one").hidden_sigils == ("no", "l") and repos.visibility().slugs == {1: "one"}
    repos.configure("one", path_config=None)
    assert len(ask(base, visibility=repos.visibility())) == 4
    v, _ = writes.apply(nothing(spark), 1, [writes.Op("create", "a:b.md")], paths=PathConfig(disallowed_chars=()))
    v, _ = writes.apply(v, 1, [writes.Op("delete", "a:b.md")], paths=PathConfig(disallowed_chars=(), system_sigils=("@",)))
    assert [r.path for r in live(v).collect()] == ["@deleted/a:b-v1.md"]


def test_link_configuration_in_layers(base):
    every = dict.fromkeys(("inline", "reference", "autolink", "wikilink", "fullpath"), True)
    repos = writes.Repos([])
    repos.create("one")
    assert repos.links() == {1: LinkConfig()}
    for bad in ({"body": {"inline": True}}, {"body": {**every, "wikilink": 1}}, {"resolution": {"wikilink_elision": True, "preserve_anchors": True, "index_basename": ""}}, {"frontmatter": []}, 3):
        with pytest.raises(EngineError) as e:
            repos.configure("one", link_config=bad)
        assert e.value.code == "link_config_invalid"
    repos.configure("one", link_config={"body": {**every, "inline": False, "fullpath": False}, "frontmatter": {**every, "fullpath": False}, "resolution": {"wikilink_elision": True, "preserve_anchors": False, "index_basename": "home"}})
    config = repos.links()[1]
    assert config == LinkConfig(Syntaxes(inline=False, fullpath=False), Syntaxes(fullpath=False), True, False, "home")
    assert links.targets(links.Edge("$body", "p#x", True), "d/s.md", config) == ("p.md", ["p.md", "p/home.md"])
    # Of the vault's links only the wikilink is left.
    again = links.reindexed(base.links, live(base.versions), 1, config).collect()
    assert [(r.field, r.target_norm) for r in again] == [("$body", "leaf.md")]
    assert again == links.backfill(live(base.versions), repos.links()).collect()
    assert links.reindexed(base.links, live(base.versions), 2, config).count() == base.links.count()
    refs = {"a": "[x][r]\n\n[r]: /y.md"}
    assert links.extract("", refs) == [] and len(links.extract("", refs, LinkConfig(frontmatter=Syntaxes()))) == 1


POLICY = """
roles:
  writer:
    grants:
      - {repo: "al*", read: "**", write: ["notes/**", "!notes/old/**"]}
      - {repo: [beta], write: "*.txt"}
  boss: {grants: [], destructive: true, impersonate: true}
principals:
  ann: {author: ann, roles: [writer]}
  bob: {roles: [writer, boss]}
"""


def test_guard(spark, base):
    ann, bob = guard.entitlement(POLICY, "ann"), guard.entitlement(POLICY, "bob", "bob <b@x>")
    assert (ann.maintain, ann.destructive, bob.maintain, bob.author) == (False, False, True, "bob <b@x>")
    bob.may("maintain")
    for wrong in (lambda: ann.may("destructive"), lambda: guard.entitlement(POLICY, "bob"), lambda: guard.entitlement(POLICY, "eve", "e")):
        with pytest.raises(EngineError):
            wrong()
    now = ids(base.versions)
    for op in (
        writes.Op("create", "x.md"), writes.Op("create", "notes/old/x.md"), writes.Op("delete", "leaf.md"),
        writes.Op("put", "notes/mid.md", prev=now["notes/mid.md"], new_path="far/mid.md"), writes.Op("put", "leaf.md", prev=now["leaf.md"], new_path="notes/leaf.md"),
    ):
        with pytest.raises(EngineError) as e:
            guard.apply(base.versions, 1, "alpha", [writes.Op("create", "notes/fine.md"), op], ann)
        assert e.value.code == "forbidden"
    with pytest.raises(EngineError) as e:
        guard.apply(base.versions, 1, "alpha", [writes.Op("create", "notes/:x.md")], ann)
    assert e.value.code == "path_invalid"
    mine = [writes.Op("create", "/notes/new.md", author="eve"), writes.Op("put", "notes/mid.md", "b", prev=now["notes/mid.md"], new_path="notes/two.md")]
    v, made = guard.apply(base.versions, 1, "alpha", mine, ann)
    assert {r.author for r in v.where(F.col("id").isin(made)).collect()} == {"ann"}
    v, made = guard.apply(base.versions, 1, "alpha", mine, bob)
    assert sorted(r.author for r in v.where(F.col("id").isin(made)).collect()) == ["bob <b@x>", "eve"]
    assert ask(base, visibility=ann.visibility(Visibility(slugs={1: "other"}))) == [] and len(ask(base, visibility=ann.visibility(Visibility(slugs={1: "alpha"})))) == 4
    rows = spark.createDataFrame([(i, p) for i in (1, 2) for p in ("notes/a.md", "notes/old/b.md", "c/d.txt", ":deleted/x.md")], "repo_id long, path string")
    got = rows.where(guard.writable(ann, {1: "alpha", 2: "beta"}, F.col("repo_id"), F.col("path"))).collect()
    assert {tuple(r) for r in got} == {(1, "notes/a.md"), (1, ":deleted/x.md"), (2, "c/d.txt"), (2, ":deleted/x.md")}
    for r in rows.collect():
        assert visibility_allows(ann, r) == (tuple(r) in {tuple(x) for x in got} and not r.path.startswith(":"))


def visibility_allows(own, row):
    return allows(own.write, {1: "alpha", 2: "beta"}[row.repo_id], row.path)

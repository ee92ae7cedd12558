"""Files in and out, and the feed as a stream."""

import os

from pyspark.sql import functions as F

from notegraph.functions import text
from notegraph.operators import history, sync, writes
from notegraph.operators.store import VERSION_SCHEMA, live
from notegraph.sources import markdown, render
from notegraph.streaming import feed
from tests.vault import FILES, nothing, vault


def test_folder_round_trip(spark, tmp_path):
    root = str(tmp_path / "in")
    for path, (raw, body) in {**FILES, "a b+c%20.md": ("", "x"), ".git/x.md": ("", "no"), "bad.md": ("a: [\n", "y"), "note.txt": ("", "no")}.items():
        os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
        with open(f"{root}/{path}", "w") as f:
            f.write(text.join(raw, body))
    rows = markdown.parsed(markdown.files(spark, root))
    got = {r.path: r for r in rows.collect()}
    assert set(got) == {p for p in FILES if "/." not in p} | {"a b+c%20.md", "bad.md"}
    assert got["bad.md"].error and got["leaf.md"].content_hash == text.content_hash(*FILES["leaf.md"])
    seeded = markdown.seeded(rows.where("error IS NULL").drop("error"))
    assert [r.path for r in seeded.orderBy("id").collect()] == sorted(p for p in got if p != "bad.md")
    out = str(tmp_path / "out")
    assert markdown.materialize(seeded, out) == len(got) - 1
    again = {r.path: r for r in markdown.parsed(markdown.files(spark, out)).collect()}
    assert all(again[p].content_hash == got[p].content_hash for p in again)
    with open(f"{out}/leaf.md") as f:
        assert "$version: v" in f.read()
    assert {r.path for r in markdown.files(spark, root, ("notes/**", "*.md"), ("lone.md",)).collect()} == set(got) - {"lone.md"}


def test_render():
    assert render.table([{"a": 1}, {"a": "x|y", "b": [1, 2]}], ["a", "b"]).split("\n")[2:] == ["| 1 |  |", "| x\\|y | 1, 2 |"]
    assert render.mermaid(["a", "b"], [("a", "b", "f"), ("a", "z", "g")]).count("-->") == 1
    assert render.report({}, False) == "no findings" and "(list truncated)" in render.report({("hash.missing", "warn"): 2}, True)


def test_feed_stream_waits_at_a_hot_gap(spark, tmp_path):
    folder, state = str(tmp_path / "log"), str(tmp_path / "state")
    schema = VERSION_SCHEMA
    v = nothing(spark)
    for i in range(5):
        v, _ = writes.apply(v, 1, [writes.Op("create", f"p{i}.md", str(i))], f"2026-01-01T00:00:0{i}.000Z")
    rows = spark.createDataFrame(v.collect(), schema)
    rows.where("id <> 3").write.parquet(folder)
    seen: list[int] = []
    read, save = feed.file_cursor(spark, str(tmp_path / "state"))
    clock = [1767225606000]  # two seconds after the last row

    def run():
        feed.run(
            feed.source(spark, folder, schema), lambda: spark.read.schema(schema).parquet(folder),
            lambda page, epoch: seen.extend(r.id for r in page.select("id").collect()), read, save, lambda: clock[0], state,
        ).awaitTermination(120)

    run()
    assert seen == [1, 2] and read() == 2
    rows.where("id = 3").write.mode("append").parquet(folder)
    run()
    assert seen == [1, 2, 3, 4, 5] and read() == 5


def test_deferred_paths_come_out_once(spark, tmp_path):
    folder = str(tmp_path / "refs")
    schema = "path string, id long, at timestamp"
    stamp = lambda m: F.to_timestamp(F.lit(f"2026-01-01 00:{m:02d}:00"))
    base = spark.range(1)
    rows = base.select(F.lit("a").alias("path"), F.lit(1).cast("long").alias("id"), stamp(0).alias("at")).unionByName(
        base.select(F.lit("a").alias("path"), F.lit(2).cast("long").alias("id"), stamp(1).alias("at"))
    )
    rows.coalesce(1).write.parquet(folder)
    q = feed.deferred(spark.readStream.schema(schema).parquet(folder), 60_000).writeStream.format("memory").queryName("held").outputMode("append")
    q = q.option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        base.select(F.lit("b").alias("path"), F.lit(9).cast("long").alias("id"), stamp(30).alias("at")).write.mode("append").parquet(folder)
        q.processAllAvailable()
        base.select(F.lit("c").alias("path"), F.lit(10).cast("long").alias("id"), stamp(31).alias("at")).write.mode("append").parquet(folder)
        q.processAllAvailable()
        assert [(r.path, r.id) for r in spark.table("held").where("path = 'a'").collect()] == [("a", 2)]
    finally:
        q.stop()


def test_feed_pages_apply_to_a_folder(spark, tmp_path):
    v = nothing(spark)
    v, (a, b) = writes.apply(v, 1, [writes.Op("create", "a.md", "1"), writes.Op("create", "b.md", "2")])
    v = spark.createDataFrame(v.collect(), VERSION_SCHEMA)
    root = str(tmp_path)
    page = lambda after: sync.net_effect(history.refs(v).where(F.col("id") > after))
    markdown.apply_refs(page(0), v, root)
    assert sorted(os.listdir(root)) == ["a.md", "b.md"]
    v, _ = writes.apply(v, 1, [writes.Op("put", "a.md", "moved", prev=a, new_path="c.md"), writes.Op("delete", "b.md")])
    v = spark.createDataFrame(v.collect(), VERSION_SCHEMA)
    for _ in range(2):
        markdown.apply_refs(page(b), v, root)
        assert sorted(os.listdir(root)) == ["c.md"]


def test_vault_is_live(spark):
    assert live(vault(spark).versions).count() == len(FILES)

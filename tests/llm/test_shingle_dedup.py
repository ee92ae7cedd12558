import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from notegraph.llm import shingle_dedup, simhash_dedup
from notegraph.llm.common import table
from tests.llm.test_simhash import union


def brute_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_roots(texts):
    sets = [brute_shingles(t) for t in texts]
    alike = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    return union(range(len(sets)), [(i, j) for j in range(len(sets)) for i in range(j) if alike(sets[i], sets[j])])


def near_copies(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    notice = [r.choice(words) for _ in range(60)]
    make = lambda n: [r.choice(words) for _ in range(n)]

    def changed(text, n):
        text = list(text)
        for _ in range(n):
            text[r.randrange(len(text))] = r.choice(words)
        return text

    texts = [make(r.randint(1, 120)) + (notice if i % 2 else []) for i in range(80)]
    for t in texts[:40]:
        texts += [changed(t, k) for k in (1, 3, 5)]
    hub = make(200)
    texts += [changed(hub, r.randint(1, 9)) for _ in range(120)] + [t[:-2] for t in texts[:20]]
    return [" ".join(t) for t in texts] + ["", " \n", "A b C d e F é", "a B c d e f É"]


@pytest.mark.parametrize("seed", range(3))
def test_stage_against_brute_force(spark, seed):
    texts = near_copies(seed)
    roots = brute_roots(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    kept = {x.doc_id for x in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == {i for i, root in roots.items() if i == root}
    assert len(kept) < len(texts) - 80


def test_stage_on_the_given_documents(spark):
    rows = {x.text.lower(): x.doc_id for x in table(spark, "/root/testdata/sf0.01", "documents").orderBy("doc_id").collect()}
    texts = sorted(rows, key=rows.get)
    want = {rows[texts[i]] for i, root in brute_roots(texts).items() if i == root}
    docs = spark.createDataFrame([(rows[t], t) for t in texts], "doc_id long, text string")
    assert {x.doc_id for x in shingle_dedup.unique(docs).collect()} == want and len(want) < len(texts)


def test_any_order_finds_the_same(spark, monkeypatch):
    texts = near_copies(9)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(shingle_dedup.unique(docs).collect())
    monkeypatch.setattr(shingle_dedup, "COMMON", 1)
    monkeypatch.setattr(shingle_dedup, "SAMPLE", 20)
    assert sorted(shingle_dedup.unique(docs).collect()) == want


def test_stage_takes_fingerprints_through_the_grid(spark, monkeypatch):
    """Pairs within two bits come from the grid join, and only those alike in their sets; the rest is found without."""
    texts = near_copies(4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marked = docs.select(F.xxhash64("text").alias("mark"), F.lower("text").cast("binary").alias("text"))
    mark = {x.t: x.m for x in docs.select(F.col("text").alias("t"), F.xxhash64("text").alias("m")).collect()}
    sets = {mark[t]: brute_shingles(t) for t in texts}
    prints = {mark[t]: simhash_dedup.fingerprint(t.lower().encode(), 5) for t in texts}
    edges = {(x.a, x.b) for x in simhash_dedup.alike(marked, 5, 0.8).collect()}
    assert edges and all(5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) for a, b in edges)
    assert all((prints[a] ^ prints[b]).bit_count() <= 2 for a, b in edges)
    calls = []
    real = simhash_dedup.links
    monkeypatch.setattr(simhash_dedup, "links", lambda points, *a: calls.append(points.count()) or real(points, *a))
    corpus_pipeline.drop_near_copies(spark, docs, "")
    assert calls == [len(set(prints.values()))]


def test_rows_are_told_by_identifier_and_text(spark):
    text = " ".join(f"word{i}" for i in range(100))
    rows = [(1, text), (2, "something else entirely, kept beside a copy"), (2, text + " more"), (None, text + " too"), (None, "without any copy at all, so it stays")]
    got = shingle_dedup.unique(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(x) for x in got} == {rows[0], rows[1], rows[4]}


@pytest.mark.parametrize("n", [1, 4, 5, 6, 50])
def test_prefix_length(n):
    own = np.arange(n, dtype=np.int64)
    first = shingle_dedup.prefix(own, np.array([0]), np.array([9]))
    assert len(first) == n - -(-4 * n // 5) + 1
    assert n < 5 or 0 not in first


@pytest.mark.parametrize("seed", range(20))
def test_met_in_batches_of_any_size(seed):
    r = random.Random(seed)
    rows = sorted((r.randrange(30), r.randrange(4)) for _ in range(80))
    rows = [(h, m, 7, h + m, h == 13) for h, m in rows]
    cuts = sorted(r.randrange(81) for _ in range(seed))
    batches = [
        pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[a:b], strict=True)], ["h", "mark", "n", "at", "common"])
        for a, b in zip([0, *cuts], [*cuts, 80], strict=True)
        if a < b
    ]
    got = [tuple(x.values()) for batch in shingle_dedup._met(iter(batches)) for x in batch.to_pylist()]
    marks = {}
    for h, m, *_ in rows:
        marks.setdefault(h, set()).add(m)
    assert sorted(got) == sorted({x[:4] for x in rows if len(marks[x[0]]) > 1 or x[4]})


def test_sketches_differ_in_no_more_bits_than_sets(spark):
    r = random.Random(2)
    rows = []
    for k in range(300):
        a = {r.getrandbits(63) for _ in range(r.choice([1, 40, 500, 1080, 3000]))}
        b = {x for x in a if r.random() < 0.9} | {r.getrandbits(63) for _ in range(r.randrange(1 + len(a) // 10))}
        wide = lambda x: max(8, 1 << (max(1, len(x) // 64) - 1).bit_length())
        own = [np.array(sorted(x), dtype=np.int64) for x in (a, b)]
        rows.append((k, len(a ^ b), *[shingle_dedup.sketch(x, wide(x)).tolist() for x in own]))
    df = spark.createDataFrame(rows, "k int, d int, x array<long>, y array<long>")
    got = df.select("d", shingle_dedup._changed("x", "y").alias("c"), F.size("x").alias("n"), F.size("y").alias("m")).collect()
    assert all(x.c <= x.d and (x.d - x.c) % 2 == 0 for x in got) and any(x.n != x.m for x in got)
    assert sum(x.c for x in got) > 0.7 * sum(x.d for x in got)

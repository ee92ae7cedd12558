import random

import numpy as np
import pytest
import xxhash

from notegraph.llm import components, simhash_dedup


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def brute_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", "one", "one two", "A b C d e F g", "é È ü  x\ty\nz", "x " * 500])
def test_fingerprint(text):
    assert simhash_dedup.fingerprint(text.encode()) == brute_fingerprint(text)


def test_long_texts_are_taken_whole(monkeypatch):
    text = " ".join(str(i * i % 9973) for i in range(5000))
    whole = simhash_dedup.fingerprint(text.encode())
    monkeypatch.setattr(simhash_dedup, "_STEP", 64)
    assert simhash_dedup.fingerprint(text.encode()) == whole == brute_fingerprint(text)


def test_engine_hash_is_the_same(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([("a b é",)], "t string").select(F.xxhash64("t")).first()[0]
    assert got == signed(xxhash.xxh64_intdigest("a b é".encode(), 42))


def union(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)]
    nodes = {x for e in edges for x in e}
    want = {n: m for n, m in union(nodes, edges).items() if n != m}
    got = components.connected(spark.createDataFrame(edges, "a long, b long"))
    assert {x.node: x.root for x in got.collect()} == want


def test_components_of_nothing(spark):
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_unary_bounds_hamming(spark):
    from pyspark.sql import functions as F

    r = random.Random(1)
    pairs = [(signed(a := r.getrandbits(64)), signed(a ^ sum(1 << r.randrange(64) for _ in range(3)) & (1 << 64) - 1)) for _ in range(200)]
    got = spark.createDataFrame(pairs, "a long, b long").select(
        F.bit_count(simhash_dedup.unary(F.col("a")).bitwiseXOR(simhash_dedup.unary(F.col("b")))), F.bit_count(F.expr("a ^ b"))
    )
    assert all(low <= exact for low, exact in got.collect())


@pytest.mark.parametrize("cell", [64, 3])
def test_links_connect_what_brute_force_does(spark, cell):
    r = random.Random(5)
    near = lambda x, k: x ^ sum(1 << b for b in r.sample(range(64), k))
    points = {r.getrandbits(64) for _ in range(150)}
    for x in list(points)[:20]:
        points |= {near(x, k) for k in (1, 2, 2, 3, 4)}
    hub = r.getrandbits(64)
    points |= {near(hub, r.choice((1, 2))) for _ in range(150)} | {0, 1, 3, 7, 15, (1 << 64) - 1}
    points = sorted(map(signed, points))
    arr = np.array(points, dtype=np.int64).view(np.uint64)
    want = union(points, [(points[i], points[j]) for i in range(len(points)) for j in range(i) if int(arr[i] ^ arr[j]).bit_count() <= 2])
    edges = simhash_dedup.links(spark.createDataFrame([(p,) for p in points], "fp long"), cell=cell)
    rows = [tuple(e) for e in edges.collect()]
    assert union(points, rows) == want
    assert len(rows) < len(points) * 80


def test_near_dedup(spark):
    r = random.Random(2)
    words = [str(i) for i in range(2000)]
    rows = []
    for i in range(60):
        text = " ".join(r.choice(words) for _ in range(400))
        rows.append((i, text))
        if i % 3 == 0:
            rows.append((1000 + i, text.replace(text.split()[-1], "zz")))
        if i % 5 == 0:
            rows.append((2000 + i, text.upper()))
    rows += [(3000, None), (3001, ""), (3002, " \n")]
    fps = {i: brute_fingerprint(t or "") for i, t in rows}
    ids = sorted(fps)
    want = union(ids, [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 2])
    got = simhash_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {x.doc_id: x.component_id for x in got} == want
    assert all(x.fingerprint == f"{fps[x.doc_id]:016x}" for x in got)

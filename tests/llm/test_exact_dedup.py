import hashlib
import random

import pytest

from notegraph.llm import exact_dedup


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(rows, keep):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[lower(t)]
        known = [x for x in ids if x is not None]
        best = (max if keep == "largest" else min)(known) if known else None
        out.append((i, best, len(ids), i == best, hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def cases():
    r = random.Random(3)
    words = ["alpha", "Beta", "GAMMA", "é", "É", "ß"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 3)))) for i in range(800)]
    rows += [(1000 + i, "The Hot Text" if i % 2 else "the hot TEXT") for i in range(500)]
    rows += [(None, "the hot text"), (None, "lonely"), (None, None), (5000, None), (5, rows[5][1]), (2000 + 1, "ÉTÉ hot"), (2002, "été hot")]
    return rows


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_against_brute_force(spark, keep):
    rows = cases()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = exact_dedup.exact_dedup(df, keep=keep).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, keep)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_unique_keeps_one_row_of_each_text(spark, keep):
    rows = cases()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = exact_dedup.unique(df, keep).collect()
    texts = [lower(r.text) for r in got]
    assert len(texts) == len(set(texts)) == len({lower(t) for _, t in rows})
    best = {lower(t): b for (_, t), b in zip(rows, [None] * len(rows), strict=True)}
    for i, k, *_ in brute(rows, keep):
        best[i] = k
    assert all(r.doc_id == best[r.doc_id] for r in got)


def test_bad_keep(spark):
    with pytest.raises(ValueError):
        exact_dedup.exact_dedup(spark.createDataFrame([], "doc_id long, text string"), keep="best")

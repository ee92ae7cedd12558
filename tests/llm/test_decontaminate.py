import random
from collections import Counter

import pytest

from notegraph.llm import decontaminate


def shingles(text):
    w = (text or "").lower().split()
    return [" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def brute(docs, items):
    """By all windows of all texts: the best similarity, and the first such window that begins with a shingle of the item."""
    out = {}
    for d, text in docs:
        s = shingles(text)
        for item, own in items:
            t = Counter(shingles(own))
            n = sum(t.values())
            for p in range(len(s)):
                window = Counter(s[p : p + n])
                shared = sum((window & t).values())
                if n and shared:
                    sim = shared / (n + sum(window.values()) - shared)
                    if sim >= 0.8:
                        best = out.get((d, item))
                        if best is None or (sim, s[p] in t, -p) > (best[0], best[3], -best[1]):
                            out[d, item] = (sim, p, sum(window.values()), s[p] in t)
    return {k: v[:3] for k, v in out.items()}


def data():
    r = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, make(r.randint(6, 50))) for i in range(25)] + [(100, "short one"), (101, "a a a a a a a a a a a a"), (102, "")]
    docs = []
    for i in range(120):
        text = make(r.randint(1, 200))
        if i % 3 == 0:
            own = r.choice(items[:25])[1].split()
            if i % 2:
                own[r.randrange(len(own))] = "changed"
            if i % 5 == 0:
                own = own[: int(len(own) * 0.9)]
            text = f"{text} {' '.join(own).upper()} {make(r.randint(0, 30))}"
        docs.append((i, text))
    docs += [(500, "short one"), (501, "short one more"), (502, "x " + "a " * 40), (503, None), (504, ""), (505, items[0][1]), (506, items[0][1] + " " + items[1][1] + " " + items[0][1])]
    return docs, items


def test_against_brute_force(spark):
    docs, items = data()
    got = decontaminate.leaks(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    want = brute(docs, items)
    assert {(x.doc_id, x.item_id): (x.similarity, x.start, x.words) for x in got} == want
    assert len(want) > 15


def test_clean_documents_stay(spark):
    docs, items = data()
    df = spark.createDataFrame(docs + [(None, "no id")], "doc_id long, text string")
    kept = decontaminate.clean(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    leaky = {d for d, _ in brute(docs, items)}
    assert {x.doc_id for x in kept} == {d for d, _ in docs if d not in leaky} | {None}


def test_the_index_holds_all_within_the_radius(spark):
    r = random.Random(3)
    pairs = []
    for k in range(2000):
        a = r.getrandbits(64)
        b = a
        for i in r.sample(range(64), k % (decontaminate.RADIUS + 1)):
            b ^= 1 << i
        pairs.append((k, decontaminate._signed(a), decontaminate._signed(b), 30))
    df = spark.createDataFrame(pairs, "k long, a long, b long, n int")
    items = decontaminate.with_block_keys(df, "a", "n", decontaminate.ITEM_FLIPS, "key").select("k", "key")
    windows = decontaminate.with_block_keys(df, "b", "n", decontaminate.WINDOW_FLIPS, "key").select("k", "key")
    assert items.join(windows, ["k", "key"]).select("k").distinct().count() == len(pairs)


def test_recall_by_length_and_similarity(spark):
    """Items with words changed or left out, in documents of their own, against an exact search."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    items, docs = [], []
    for i in range(400):
        own = [r.choice(words) for _ in range(r.choice([16, 30, 60, 150]))]
        items.append((i, " ".join(own)))
        for _ in range(3):
            text = list(own)
            for _ in range(r.randrange(1 + len(own) // 40)):
                text[r.randrange(len(text))] = r.choice(words)
            cut = r.randrange(1 + len(own) // 8)
            text = text[cut // 2 : len(text) - (cut - cut // 2)]
            docs.append((len(docs), " ".join([r.choice(words) for _ in range(r.randrange(40))] + text + [r.choice(words) for _ in range(r.randrange(40))])))
    want = {}
    for d, (_, text) in enumerate(docs):
        want |= brute([(d, text)], [items[d // 3]])
    got = {(x.doc_id, x.item_id): (x.similarity, x.start, x.words) for x in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert all(want[k] == v for k, v in got.items())
    bands = {}
    for k, v in want.items():
        band = bands.setdefault((len(items[k[1]][1].split()), int(v[0] * 20) / 20), [0, 0])
        band[0] += k in got
        band[1] += 1
    print(sorted(bands.items()))
    assert all(a >= 0.9 * b for a, b in bands.values()) and len(got) >= 0.99 * len(want) > 500


def test_long_texts_are_cut_into_stretches(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "STRETCH", 7)
    docs, items = data()
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id): (x.similarity, x.start, x.words) for x in got} == brute(docs, items)


def test_a_large_benchmark_is_joined(spark, monkeypatch):
    docs, items = data()
    monkeypatch.setattr(decontaminate, "SENT", 0)
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id): (x.similarity, x.start, x.words) for x in got} == brute(docs, items)


def test_rows_are_cleaned_by_their_text(spark):
    item = " ".join(f"item{i}" for i in range(30))
    rows = [(None, f"before {item} after"), (None, "clean and without identifier"), (1, f"x {item}"), (1, "clean text with the same identifier"), (2, None)]
    got = decontaminate.clean(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {tuple(x) for x in got.collect()} == {rows[1], rows[3], rows[4]}

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions

from notegraph.llm import ngrams, quality, toxicity


def words_of(column):
    out = {}
    for first, n, words, stems, row in ngrams.word_groups(column, (4,)):
        for k in range(n):
            out[first + k] = (words[row == k].tolist(), stems[0][row == k].tolist())
    return out


def test_words_hash_alike_wherever_they_stand(monkeypatch):
    texts = ["Hello, wörld! HELLO", None, "", "hello", "x" * 50 + " WÖRLD", "hell", "a1 b2"]
    col = pa.array([t.encode() if t is not None else None for t in texts], pa.binary())
    got = words_of(col)
    assert got[0][0][0] == got[0][0][2] == got[3][0][0]
    assert got[0][0][1] == got[4][0][1]
    assert got[1] == got[2] == ([], [])
    assert got[0][1][0] == got[5][1][0] and got[0][0][0] != got[5][0][0]
    monkeypatch.setattr(ngrams, "CHUNK", 8)
    assert words_of(pa.array([b"hello world hello", b"again"], pa.binary()))[0][0][0] == got[3][0][0]


def test_slices_and_long_texts(monkeypatch):
    long = " ".join(f"w{i}" for i in range(3000)).encode()
    col = pa.array([b"skip me", long, b"tail"], pa.binary()).slice(1)
    whole = words_of(col)
    monkeypatch.setattr(ngrams, "CHUNK", 100)
    assert words_of(col) == whole and len(whole[0][0]) == 3000


def texts(n, seed, bad):
    r = random.Random(seed)
    out = []
    for i in range(n):
        y = i % 4 == 0
        words = [f"w{r.randrange(400)}" for _ in range(r.randint(5, 60))]
        if y:
            for _ in range(3):
                words.insert(r.randrange(len(words)), bad(r))
        out.append((i, " ".join(words), int(y)))
    return out


@pytest.mark.parametrize(
    ("run", "label", "bad", "folds", "out"),
    [
        (toxicity.toxicity, "toxic", lambda r: r.choice(["vileword", "nastyone"]), 4, 2),
        (quality.quality, "quality", lambda r: f"w{r.randrange(400)}@@@", 5, 0),
    ],
)
def test_held_out_rows(spark, run, label, bad, folds, out):
    rows = texts(1200, 1, bad)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], f"doc_id long, {label} int")
    got = {x.doc_id: x for x in run(docs, labels).collect()}
    for i, _, _ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % folds == out)
        assert got[i].predicted == int(got[i].score >= 0.3)
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.95
    # Labels of held-out rows teach nothing.
    flipped = spark.createDataFrame([(i, 1 - y if got[i].held_out else y) for i, _, y in rows], f"doc_id long, {label} int")
    again = {x.doc_id: x.score for x in run(docs, flipped).collect()}
    assert all(again[i] == got[i].score for i in again)


def test_ftrl_weights_are_sparse():
    r = np.random.default_rng(0)
    rows = [np.unique(r.integers(0, 5000, 80)) for _ in range(600)]
    y = np.array([float(i % 3 == 0) for i in range(600)])
    rows = [np.unique(np.append(x, 7)) if t else x[x != 7] for x, t in zip(rows, y, strict=True)]
    w, bias = toxicity.fit(rows, y)
    assert w[7] > 1 and (w != 0).sum() < 1000
    p = np.array([bias + w[x].sum() for x in rows]) > 0
    assert (p == y).mean() > 0.97


def test_dual_descent_meets_the_optimum():
    """The margin conditions of the dual hold at the end."""
    r = np.random.default_rng(1)
    rows = [np.sort(r.choice(40, 8, replace=False)) for _ in range(60)]
    y = np.array([float(x.sum() % 2) for x in rows])
    scale = np.where(np.arange(1 << quality.BITS) < 40, r.normal(size=1 << quality.BITS), 0.0)
    w = quality.descend(rows, y, scale, epochs=3000)
    raw = np.append(np.divide(w[:-1], scale, out=np.zeros_like(scale), where=scale != 0), w[-1])
    cost = {s: 60 / (2 * (y == s).sum()) for s in (0.0, 1.0)}
    loss = lambda v: 0.5 * v @ v + sum(cost[t] * max(0.0, 1 - (1 if t else -1) * ((v[x] * scale[x]).sum() + v[-1])) for x, t in zip(rows, y, strict=True))
    best = loss(raw)
    for _ in range(30):
        step = np.zeros_like(raw)
        step[:40], step[-1] = r.normal(size=40) * 0.02, r.normal() * 0.02
        assert loss(raw + step) >= best - 1e-2


def test_ftrl_coordinate_by_coordinate():
    """The update written out for one coordinate at a time."""
    import math

    r = random.Random(4)
    rows = [sorted(r.sample(range(30), r.randint(0, 12))) for _ in range(120)]
    labels = [float(3 in x or 7 in x) for x in rows]
    alpha, beta, l1, l2, positive = 0.7, 1.0, 1.5, 0.3, 1.5
    z, n, bias, seen = [0.0] * 30, [0.0] * 30, 0.0, 1.0
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)
    for _ in range(3):
        for x, y in zip(rows, labels, strict=True):
            p = 1 / (1 + math.exp(-(bias + sum(weight(i) for i in x))))
            g = (p - y) * (positive if y else 1.0)
            seen += g * g
            bias -= 0.5 * g / math.sqrt(seen)
            for i in x:
                rate = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - rate * weight(i)
                n[i] += g * g
    w, b = toxicity.fit([np.array(x, dtype=np.int64) for x in rows], np.array(labels), 3, alpha, beta, l1, l2, positive)
    assert np.allclose(w[:30], [weight(i) for i in range(30)]) and abs(b - bias) < 1e-9
    assert not w[30:].any() and (w[:30] == 0).any() and (w[:30] != 0).any()


@pytest.mark.parametrize("score", [toxicity.toxicity, quality.quality])
def test_rows_without_words_get_the_score_of_the_intercept(spark, score):
    rows = [(i, "bad awful words here" if i % 3 == 0 else "good fine words there") for i in range(90)]
    odd = [(1000, None), (1001, ""), (None, ""), (1002, ""), (1002, ""), (5, "bad awful words here"), (5, "good fine words there")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 3 == 0)) for i in range(90)] + [(0, 0, 0)], "doc_id long, quality int, toxic int")
    got = score(spark.createDataFrame(rows + odd, "doc_id long, text string"), labels).collect()
    assert len(got) == 97 and len({x.score for x in got if x.doc_id is None or x.doc_id >= 1000}) == 1
    own = sorted(x.score for x in got if x.doc_id == 5)
    assert len(own) == 3 and own[0] < own[-1] and len(set(own)) == 2
    assert not any(x.held_out for x in got if x.doc_id is None)


def test_a_share_of_very_many_labels_is_not_empty(spark):
    df = spark.range(200_000).select(functions.col("id").alias("doc_id"))
    assert df.where(toxicity._share(1e-3, 5)).count() > 100
    assert df.where(toxicity._share(6000 / 1e13, 5)).count() == 0  # none of these, but the bound is not zero
    assert int(((1 << 63) - 1) * 6000 / 1e13) > 1e9

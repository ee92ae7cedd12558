import random

import pytest
from pyspark.sql import functions as F

from notegraph.llm import mixing


def naive(votes, seats, most):
    held = [0] * len(votes)
    for _ in range(seats):
        able = [i for i in range(len(votes)) if votes[i] and held[i] < most[i]]
        if not able:
            break
        held[max(able, key=lambda i: (votes[i] / (2 * held[i] + 1), -i))] += 1
    return held


@pytest.mark.parametrize("seed", range(30))
def test_seats_go_by_highest_quotients(seed):
    r = random.Random(seed)
    votes = [r.choice([0, 1, 5, r.random() * 100, r.randrange(1000)]) for _ in range(r.randrange(1, 12))]
    seats = r.randrange(0, 60)
    assert mixing.highest_quotients(votes, seats) == naive(votes, seats, [seats] * len(votes))
    most = [r.randrange(0, 20) for _ in votes]
    assert mixing.highest_quotients(votes, seats, most) == naive(votes, seats, most)


@pytest.mark.parametrize("seed", range(5))
def test_seats_of_a_table(spark, seed):
    r = random.Random(seed)
    votes = [float(r.choice([0, 1, 1, 5, r.randrange(1, 1000)])) for _ in range(r.randrange(1, 40))]
    seats = r.randrange(0, 200)
    df = spark.createDataFrame(list(enumerate(votes)), "at long, v double")
    got = [x.quota for x in mixing.apportioned(df, "v", seats).orderBy("at").collect()]
    assert got == (naive(votes, seats, [seats] * len(votes)) if sum(votes) else [0] * len(votes))


def plain_targets(sizes, weights, share, limit):
    """Targets dealt out by the rule of the contract, one round after the other."""
    out, full, left = [0.0] * len(sizes), set(), share * sum(sizes)
    while True:
        able = [i for i in range(len(sizes)) if sizes[i] and i not in full]
        unit = left / sum(weights[i] for i in able) if able else 0
        over = [i for i in able if unit * weights[i] > limit * sizes[i]]
        for i in over:
            full.add(i)
            out[i] = limit * sizes[i]
            left -= out[i]
        if not over:
            for i in able:
                out[i] = unit * weights[i]
            return out


def check(got, n):
    assert len(got) == n
    sizes = {}
    for x in got:
        sizes[x.source] = sizes.get(x.source, 0) + x.size
        assert 0 <= x.taken <= 2 * x.size
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    want = dict(zip(names, plain_targets([sizes[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2.0), strict=True))
    for s in names:
        own = [x for x in got if x.source == s]
        assert {x.source_size for x in own} == {sizes[s]}
        assert all(x.target == pytest.approx(want[s]) for x in own)
        assert sum(x.taken for x in own) == pytest.approx(want[s], rel=0.01, abs=1.5), s


def rows(n=3000):
    r = random.Random(4)
    out = [(i, " ".join("w" * r.randint(1, 4) for _ in range(r.choice([0, 1, 7, 40, 300]))), r.choice(["a", "a", "a", "b", "é", "Z", None])) for i in range(n)]
    return out + [out[3], (None, "x y", "a"), (None, None, "only"), (n, "lone words", "tiny")]


@pytest.mark.parametrize("shard_words", [1 << 22, 3000])
def test_mix(spark, shard_words):
    df = spark.createDataFrame(rows(), "doc_id long, text string, source string")
    got = mixing.mix(df.repartition(7), shard_words=shard_words).collect()
    again = mixing.mix(df.repartition(3), shard_words=shard_words).collect()
    key = lambda x: repr(tuple(x))
    assert sorted(got, key=key) == sorted(again, key=key)
    check(got, len(rows()))


@pytest.mark.parametrize("sources", [2, 3, 7])
@pytest.mark.parametrize("words", [1, 4, 5])
def test_short_texts_reach_their_targets(spark, words, sources):
    text = F.concat_ws(" ", F.array_repeat(F.lit("w"), words))
    same = F.when(F.col("id") % 3 > 0, F.col("id") % 5)  # null identifiers and repeated ones
    df = spark.range(40_000).select(same.alias("doc_id"), F.concat(text, F.lit(" "), F.col("id") % 977).alias("text"), F.concat(F.lit("s"), F.col("id") % sources).alias("source"))
    check(mixing.mix(df, shard_words=20_000).collect(), 40_000)


def test_blocks_are_chosen_evenly(spark):
    df = spark.range(37).select(F.col("id").alias("j"))
    for rest, first in ((0, 5), (1, 36), (10, 0), (36, 7)):
        at = [x[0] for x in df.select(mixing.chosen(F.col("j") + 1, F.lit(rest), F.lit(37), F.lit(first)) - mixing.chosen(F.col("j"), F.lit(rest), F.lit(37), F.lit(first))).collect()]
        assert set(at) <= {0, 1} and sum(at) == rest


def test_against_a_plain_deal(spark):
    """One shard: its words in turn, block by block, each chosen as its quota says."""
    r = random.Random(8)
    df = spark.createDataFrame([(i, " ".join("x" * r.randint(0, 30)), "s" if i % 3 else "t") for i in range(300)], "doc_id long, text string, source string")
    turn = {x.doc_id: x.t for x in df.select("doc_id", F.xxhash64("doc_id", "text", F.lit(17)).alias("t")).collect()}
    got = mixing.mix(df, block_words=8).collect()
    goals = {s: next(x.target for x in got if x.source == s) for s in "st"}
    quota = dict(zip("st", naive([goals["s"], goals["t"]], round(sum(goals.values()) / 8), [10**6] * 2), strict=True))
    for at, s in enumerate("st"):
        own = sorted((x for x in got if x.source == s), key=lambda x: turn[x.doc_id])
        line = [x.doc_id for x in own for _ in range(x.size)]
        blocks = [line[k : k + 8] for k in range(0, len(line), 8)]
        passes, rest = divmod(quota[s], len(blocks))
        first = spark.range(1).select(F.pmod(F.xxhash64(F.lit(17), F.lit(at).cast("long"), F.lit(0).cast("int")), F.lit(len(blocks)))).first()[0]
        taken = dict.fromkeys((x.doc_id for x in own), 0)
        for j, block in enumerate(blocks):
            times = passes + ((j + 1) * rest + first) // len(blocks) - (j * rest + first) // len(blocks)
            for d in block:
                taken[d] += times
        assert taken == {x.doc_id: x.taken for x in own}


def test_sizes_count_words(spark):
    df = spark.createDataFrame([(1, " a\tb  c\n", "x"), (2, "a b", "x"), (3, None, "x")], "doc_id long, text string, source string")
    assert {x.doc_id: x.size for x in mixing.mix(df).collect()} == {1: 3, 2: 1, 3: 0}

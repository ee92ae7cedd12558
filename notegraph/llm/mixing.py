"""Mixing sources to target weights by Sainte-Lague apportionment.

The mix is counted in blocks of equally many words. Blocks are allocated to sources by the highest
quotients target / (2 k + 1), and those of a source to its shards in the same way, no shard above
what it can give, so that what one can't take goes to the next quotient. That gives every shard an
integer quota. A shard lays its documents out in a seeded order and cuts them into blocks; its quota
is whole passes over all blocks and, for the rest, blocks spread evenly over it from a seeded one on.

Sources, targets and quotas are tables; only single numbers come to the driver.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notegraph.llm.common import WORD, durable

WEIGHTS = (3, 1, 2)
#: Words and documents of a shard, about, and the most shards of one source: its plan is solved in one
#: task. A source with more than SHARDS times as much gets larger shards.
SHARD_WORDS, SHARD_DOCS = 1 << 18, 32
SHARDS = 1 << 16
BLOCK = 1024
#: Divisors that are tried at once, and how often.
TRIED, ROUNDS = 32, 12


def highest_quotients(votes: list[float], seats: int, most: list[int] | None = None) -> list[int]:
    """Seats by highest quotients votes / (2 k + 1), none above ``most``; ties go to the earlier party.
    Rounding at the mean divisor is such an allocation for its own number of seats, so only the
    difference is dealt. Fewer than ``seats`` are dealt only if all parties with votes are at ``most``."""
    total = sum(votes)
    if not total or seats <= 0:
        return [0] * len(votes)
    top = most or [seats] * len(votes)
    held = [min(c, int(v * seats / total + 0.5)) for v, c in zip(votes, top, strict=True)]
    over = sum(held) - seats
    if over < 0:
        heap = [(-v / (2 * k + 1), i) for i, (v, k) in enumerate(zip(votes, held, strict=True)) if v and k < top[i]]
        heapq.heapify(heap)
        while over < 0 and heap:
            _, i = heapq.heappop(heap)
            held[i] += 1
            over += 1
            if held[i] < top[i]:
                heapq.heappush(heap, (-votes[i] / (2 * held[i] + 1), i))
    elif over > 0:
        heap = [(v / (2 * k - 1), -i) for i, (v, k) in enumerate(zip(votes, held, strict=True)) if k]
        heapq.heapify(heap)
        for _ in range(over):
            _, i = heapq.heappop(heap)
            held[-i] -= 1
            if held[-i]:
                heapq.heappush(heap, (votes[-i] / (2 * held[-i] - 1), i))
    return held


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` numbered from 0 in the order of ``name``, null last: ranges of it are numbered each, and
    the rows of the ranges before are added."""
    order = [F.col(name).isNull(), F.col(name)]
    dealt = durable(
        rows.repartitionByRange(*order)
        .withColumn("part", F.spark_partition_id())
        .withColumn("own", F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1)
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = dealt.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    return dealt.join(starts, "part").withColumn("at", (F.col("start") + F.col("own")).cast("long")).drop("part", "own", "start")


def level(sources: DataFrame, share: float, limit: float) -> float:
    """Words for each unit of weight, such that targets of weight times it, stopped at ``limit`` times the
    size, add up to ``share`` of all sizes: what the stopped ones leave is dealt again until none is above."""
    unit, total = 0.0, None
    while True:
        stopped = F.lit(unit) * F.col("weight") > limit * F.col("n")
        row = sources.where("n > 0").agg(
            F.sum("n").alias("total"),
            F.sum(F.when(stopped, F.col("n"))).alias("held"),
            F.sum(F.when(~stopped, F.col("weight"))).alias("weight"),
        ).first()
        total = total or row["total"] or 0
        if not row["weight"]:
            return unit
        now = max(unit, (share * total - limit * (row["held"] or 0)) / row["weight"])
        if now <= unit:
            return unit
        unit = now


def apportioned(parties: DataFrame, votes: str, seats: int) -> DataFrame:
    """``parties`` with ``quota``: ``seats`` seats by highest quotients. At the right divisor every
    party's seats are its votes by the divisor, rounded; it is bracketed by counting the seats at many
    divisors at once. Parties that tie at it get the last seats in the order of ``at``."""
    row = parties.agg(F.coalesce(F.sum(votes), F.lit(0.0)), F.count(F.when(F.col(votes) > 0, 1))).first()
    total, n = float(row[0]), int(row[1])
    if not total or seats <= 0:
        return parties.withColumn("quota", F.lit(0).cast("long"))
    rounded = lambda d: F.floor(F.col(votes) / F.lit(d) + 0.5)
    # A divisor with too many seats, or enough, and one with too few.
    low, high = total / (seats + n + 1), total / max(seats - n - 1, 0.25)
    for _ in range(ROUNDS):
        tried = [float(d) for d in np.linspace(low, high, TRIED + 2)[1:-1]]
        got = parties.agg(*[F.sum(rounded(d)).alias(f"s{k}") for k, d in enumerate(tried)]).first()
        exact = [d for d, s in zip(tried, got, strict=True) if s == seats]
        if exact:
            return parties.withColumn("quota", rounded(exact[0]).cast("long"))
        low = max([low, *[d for d, s in zip(tried, got, strict=True) if s > seats]])
        high = min([high, *[d for d, s in zip(tried, got, strict=True) if s < seats]])
        if high - low <= 4e-16 * high:
            break
    held = parties.withColumn("quota", rounded(high).cast("long"))
    left = seats - int(held.agg(F.sum("quota")).first()[0])
    last = (
        held.where(rounded(low) > F.col("quota"))
        .orderBy((F.col(votes) / (2 * F.col("quota") + 1)).desc(), "at")
        .limit(left)
        .select("at", F.lit(1).alias("more"))
    )
    return held.join(last, "at", "left").withColumn("quota", F.col("quota") + F.coalesce("more", F.lit(0))).drop("more")


def _dealt(shards: pd.DataFrame) -> pd.DataFrame:
    """The quotas of the shards of one source."""
    shards = shards.sort_values("shard")
    held = highest_quotients(shards["n"].tolist(), int(shards["quota"].iloc[0]), shards["most"].tolist())
    return shards.assign(own=held)[["at", "shard", "n", "blocks", "own"]]


def chosen(upto: Column, rest: Column, blocks: Column, first: Column) -> Column:
    """How many of the first ``upto`` of ``blocks`` blocks are among the ``rest`` chosen ones: block j is
    if (j rest + first) / blocks passes a whole number before the next block, so they lie evenly."""
    return F.floor((upto * rest + first) / blocks)


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    limit: float = 2.0,
    seed: int = 17,
    block_words: int | None = None,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for each row of ``docs``.

    ``size`` is the number of words of the text (null: 0). Sources in order of code points, null last,
    take ``weights`` in turn. ``taken`` counts the words that the mix takes, repeats included, at most
    ``limit`` times the size, rounded up to whole passes. ``block_words``: by default such that the least
    positive target has 256 blocks, 1 at least and 1024 at most. The taken words of a source differ from
    its target by a block for each of its shards at most, and a shard has 256 blocks or more where its
    source has so many. Null identifiers and repeated rows are documents like any others; rows equal in
    identifier, source and text share a shard. A source without words has target 0; an empty table
    gives an empty result. The same rows give the same result however they are stored.
    """
    sizes = durable(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.xxhash64("doc_id", "text", F.lit(seed)).alias("turn"),
            F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        )
    )
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("docs"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    sources = durable(numbered(by_source, "source").withColumn("weight", weight))
    unit = level(sources, share, limit)
    target = F.when(F.col("n") > 0, F.least(F.lit(unit) * F.col("weight"), F.lit(float(limit)) * F.col("n"))).otherwise(0.0)
    goals = durable(sources.withColumn("target", target))
    row = goals.agg(F.min(F.when(F.col("target") > 0, F.col("target"))), F.sum("target")).first()
    block = block_words or max(1, min(BLOCK, int((row[0] or 1) / 256)))
    own_words = max(shard_words, 256 * block)
    parts = F.least(F.floor(F.col("n") / own_words), F.floor(F.col("docs") / SHARD_DOCS), F.lit(SHARDS))
    quotas = apportioned(goals, "target", round((row[1] or 0) / block))
    plan = durable(
        quotas.select(
            F.col("source").alias("own"), "at", F.col("n").alias("source_size"), "target", "quota", F.greatest(parts, F.lit(1)).cast("int").alias("parts")
        )
    )
    # Small tables are sent whole by the optimiser, which knows their size; a hot source can be split.
    placed = durable(
        sizes.join(plan.drop("quota"), F.col("own").eqNullSafe(F.col("source")))
        .withColumn("shard", F.pmod(F.xxhash64("turn", F.lit(1)), F.col("parts")).cast("int"))
        .drop("own", "parts")
    )
    blocks = F.ceil(F.col("n") / block).cast("long")
    shards = (
        placed.groupBy("at", "shard")
        .agg(F.sum("size").alias("n"))
        .withColumn("blocks", blocks)
        .withColumn("most", F.floor(limit * F.col("blocks")).cast("long"))
        .join(plan.select("at", "quota"), "at")
    )
    runs = durable(
        shards.groupBy("at")
        .applyInPandas(_dealt, "at long, shard int, n long, blocks long, own long")
        .where("blocks > 0")
        .select(
            "at",
            "shard",
            "blocks",
            F.floor(F.col("own") / F.col("blocks")).alias("passes"),
            (F.col("own") % F.col("blocks")).alias("rest"),
            F.pmod(F.xxhash64(F.lit(seed), "at", "shard"), F.col("blocks")).alias("first"),
        )
    )
    before = (
        Window.partitionBy("at", "shard")
        .orderBy("turn", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    laid = placed.withColumn("c", F.coalesce(F.sum("size").over(before), F.lit(0))).join(runs, ["at", "shard"], "left")

    def upto(place: Column) -> Column:
        """Words of the chosen blocks before ``place``."""
        j = F.floor(place / block)
        at = lambda k: chosen(k, F.col("rest"), F.col("blocks"), F.col("first"))
        return at(j) * block + (at(j + 1) - at(j)) * (place % block)

    taken = F.col("passes") * F.col("size") + upto(F.col("c") + F.col("size")) - upto(F.col("c"))
    return laid.select("doc_id", "source", "size", "source_size", "target", F.coalesce(taken, F.lit(0)).cast("long").alias("taken"))

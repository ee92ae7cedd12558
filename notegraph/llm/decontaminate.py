"""Benchmark decontamination with DataFrame functions alone.

Texts and benchmark items are sequences of five-word shingles. An item is compared with windows of its own
size: all of them that may be alike are fingerprinted by SimHash, whatever item they may be of, and
matched to items of that size by a multi-index of Hamming blocks. A fingerprint is cut into BLOCKS
blocks; two within RADIUS differing bits differ in at most SLACK bits of some block, and meet because
the index holds every block of an item with up to ITEM_FLIPS bits flipped and a window asks for every
block of its own with up to WINDOW_FLIPS. Pairs that the index finds are verified by the exact
similarity of their weighted shingles, over all windows of the text.

A window can't be alike to an item of its size unless nearly all of its shingles occur in items of that
size. So only windows are fingerprinted that have so many; and since a window moved right to the next
of them loses none, only those that start with one.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegraph.llm.common import SPACE, durable, held

WORDS = 5
SIMILARITY = 0.8
#: Fingerprints of windows at similarity 0.8 differ in 9.7 bits of 64 in the mean, with deviation 2.9: one or two in
#: a thousand of them differ in more than 19, and fewer of those more alike.
BLOCKS = 5
WINDOW_FLIPS, ITEM_FLIPS = 1, 2
SLACK = WINDOW_FLIPS + ITEM_FLIPS
RADIUS = BLOCKS * (SLACK + 1) - 1
#: Bytes of the benchmark's tables that are sent to the executors; larger ones are joined by shuffles.
SENT = 64 << 20
#: Shingles of a text that are looked at together, besides those of the longest item.
STRETCH = 4096


def with_shingles(rows: DataFrame, text: Column, into: str = "shingles", words: int = WORDS) -> DataFrame:
    """``rows`` with the hashes of the ``words``-word shingles of the lower-cased text, in order and
    repeats included. Fewer words make one shingle; none, or null, make an empty array."""
    tokens = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), "")
    rows = held(rows, "_words", F.transform(tokens, lambda x: F.xxhash64(x)))
    at = F.sequence(F.lit(0), F.greatest(F.size("_words") - words, F.lit(0)))
    one = F.transform(at, lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(words)]))
    none = F.array().cast("array<bigint>")
    return held(rows, into, F.when(F.size("_words") > 0, one).otherwise(none)).drop("_words")


def with_simhash(rows: DataFrame, shingles: str, into: str) -> DataFrame:
    """``rows`` with the 64-bit SimHash of the hashes in ``shingles``, each weighing as often as it
    occurs. Bits s and s + 32 are counted in the two halves of one sum."""
    lanes = F.lit(0x0000000100000001)
    sums = F.transform(
        F.sequence(F.lit(0), F.lit(31)),
        lambda s: F.aggregate(
            F.col(shingles), F.lit(0).cast("long"), lambda a, x: a + F.call_function("shiftrightunsigned", x, s).bitwiseAND(lanes)
        ),
    )
    rows = held(rows, "_sums", sums)
    most = lambda count: (count * 2 > F.size(shingles)).cast("long")
    half = F.lit(0xFFFFFFFF)
    bits = F.aggregate(
        F.sequence(F.lit(0), F.lit(31)),
        F.lit(0).cast("long"),
        lambda a, s: a.bitwiseOR(
            F.call_function("shiftleft", most(F.get("_sums", s).bitwiseAND(half)), s)
        ).bitwiseOR(F.call_function("shiftleft", most(F.shiftrightunsigned(F.get("_sums", s), 32)), s + 32)),
    )
    return held(rows, into, bits).drop("_sums")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def with_block_keys(rows: DataFrame, fp: str, size: str, flips: int, into: str) -> DataFrame:
    """``rows``, one for each block of ``fp`` and each way to flip up to ``flips`` of its bits, with the key that a
    block so changed has for windows of ``size`` shingles."""
    edges = [64 * k // BLOCKS for k in range(BLOCKS + 1)]
    ways = [
        F.struct(F.lit(k).alias("k"), F.lit(_signed((1 << b) - (1 << a))).alias("own"), F.lit(_signed(sum(1 << i for i in bits))).alias("flip"))
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))
        for n in range(flips + 1)
        for bits in combinations(range(a, b), n)
    ]
    # A hash of block, size and bits can only add candidates.
    key = F.xxhash64("_way.k", size, F.col(fp).bitwiseXOR(F.col("_way.flip")).bitwiseAND(F.col("_way.own")))
    return rows.withColumn("_way", F.explode(F.array(*ways))).withColumn(into, key).drop("_way")


def _small(table: DataFrame, size: int) -> DataFrame:
    return F.broadcast(table) if size <= SENT else table


def stretches(texts: DataFrame, known: DataFrame, bytes_: int, longest: int, least: int) -> DataFrame:
    """(doc_id, mark, base, own, at) of the stretches of ``texts`` (doc_id, mark, text) with ``least`` or more shingles
    in ``known`` (h, sizes): the shingles ``own`` from ``base`` on, STRETCH of them and as many more as the longest
    item has, and for those known the place in it and the sizes of the items that have it."""
    cut = F.sequence(F.lit(0), F.greatest(F.size("shingles") - 1, F.lit(0)), F.lit(STRETCH))
    rows = with_shingles(texts, F.col("text")).where(F.size("shingles") > 0).select("doc_id", "mark", "shingles", F.explode(cut).alias("base"))
    rows = held(rows, "own", F.slice("shingles", F.col("base") + 1, STRETCH + longest)).drop("shingles")
    key = ["doc_id", "mark", "base"]
    places = F.collect_set(F.struct("p", "sizes")).alias("at")
    if bytes_ <= SENT:
        hits = rows.select(*key, "own", F.posexplode("own").alias("p", "h")).join(F.broadcast(known), "h")
        found = hits.groupBy(*key).agg(F.first("own").alias("own"), places)
    else:  # the shingles alone are shuffled, and the texts that have some of the benchmark's read again
        hits = rows.select(*key, F.posexplode("own").alias("p", "h")).join(known, "h")
        own = durable(hits.groupBy(*key).agg(places).where(F.size("at") >= least)).withColumnsRenamed({"doc_id": "d", "mark": "m", "base": "b"})
        same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")) & (F.col("base") == F.col("b"))
        found = rows.dropDuplicates(key).join(own, same).drop("d", "m", "b")
    return found.where(F.size("at") >= least).withColumn("at", F.array_sort("at"))


def windows(rows: DataFrame, similarity: float) -> DataFrame:
    """A row for each ``start`` of a ``window`` that may be alike to an item of ``n`` shingles, for rows of stretches
    with such a size each."""
    rows = held(rows, "_own_at", F.transform(F.filter("at", lambda x: F.array_contains(x["sizes"], F.col("n"))), lambda x: x["p"]))
    rows = rows.where(F.size("_own_at") >= F.ceil(F.col("n") * similarity - 1e-9))
    rows = rows.select("*", F.posexplode("_own_at").alias("_i", "start")).where(F.col("start") < STRETCH)
    n = F.col("n")
    needed = F.ceil((n + F.least(n, F.size("own") - F.col("start"))) * (similarity / (1 + similarity)) - 1e-9).cast("int")
    rows = rows.where(F.get("_own_at", F.col("_i") + needed - 1) < F.col("start") + n).drop("_i", "_own_at")
    return held(rows, "window", F.slice("own", F.col("start") + 1, n))


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = SIMILARITY,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, similarity, start, words) for each document and benchmark item of which the
    document has a window: ``similarity`` of the most similar one, the first shingle of the first such
    that begins with a shingle of the item, and its number of shingles.

    A window has as many five-word shingles as the item, or fewer at the end of the text; the
    similarity of two multisets of shingles is the size of their intersection by that of their union.
    Items of fewer than five words are one shorter shingle, found in documents that consist of it.
    Null and empty texts and items match nothing. Rows with the same identifiers are taken together,
    null identifiers too. Other columns are ignored; an empty table on either side gives no rows.
    """
    items = with_shingles(benchmark.select("item_id", F.col("text").alias("_text")), F.col("_text"), "item_own")
    items = items.drop("_text").where(F.size("item_own") > 0).distinct()
    items = items.select("item_id", "item_own", F.size("item_own").alias("n"), F.array_distinct("item_own").alias("once"))
    items = durable(with_simhash(items, "item_own", "item_fp").withColumn("item", F.xxhash64("item_id", "item_own")))
    sizes = items.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(1)), F.coalesce(F.min("n"), F.lit(1))).first()
    total, count, longest, shortest = sizes
    known = items.select("n", F.explode("once").alias("h")).groupBy("h").agg(F.collect_set("n").alias("sizes"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))
    # A shingle of the benchmark takes some 100 bytes with the sizes of its items, of which there are no more than shingles.
    found = durable(stretches(texts, known, 100 * total, longest, max(1, math.ceil(shortest * similarity - 1e-9))))

    key = ["doc_id", "mark", "base"]
    sized = found.withColumn("n", F.explode(F.array_distinct(F.flatten(F.transform("at", lambda x: x["sizes"])))))
    near = windows(sized, similarity).select(*key, "n", "window")
    near = with_simhash(near, "window", "fp").select(*key, "n", "fp").distinct()
    index = with_block_keys(items.select("item", "item_fp", "n"), "item_fp", "n", ITEM_FLIPS, "block").select("block", "item", "item_fp")
    ways = sum(1 for k in range(ITEM_FLIPS + 1) for _ in combinations(range(-(-64 // BLOCKS)), k)) * BLOCKS
    met = with_block_keys(near, "fp", "n", WINDOW_FLIPS, "block").join(_small(index, 48 * ways * count), "block")
    met = met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    pairs = durable(met.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), F.col("base").alias("b"), "item").distinct())
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")) & (F.col("base") == F.col("b"))
    whole = _small(items.select("item", "item_id", "item_own", "once", "n"), 20 * total + 200 * count)
    tried = windows(found.join(pairs, same).drop("d", "m", "b").join(whole, "item"), similarity)
    tried = tried.where(F.array_contains("once", F.get("own", "start")))
    count_in = lambda array, h: F.size(F.filter(array, lambda x: x == h))
    shared = F.aggregate("once", F.lit(0), lambda a, h: a + F.least(count_in(F.col("window"), h), count_in(F.col("item_own"), h)))
    alike = held(tried, "shared", shared).select(
        "doc_id",
        "item_id",
        (F.col("shared") / (F.col("n") + F.size("window") - F.col("shared"))).alias("similarity"),
        (F.col("base") + F.col("start")).alias("start"),
        F.size("window").alias("words"),
    )
    best = (
        alike.where(F.col("similarity") >= similarity)
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), "words")).alias("b"))
    )
    return best.select("doc_id", "item_id", "b.similarity", (-F.col("b.s")).alias("start"), "b.words")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text has no leak. Rows are told by the hash of their text, so those with a
    null identifier go too if they leak, and clean ones stay whatever else has their identifier."""
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    found = leaks(docs.select(mark.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("_leaky")).distinct()
    return docs.join(found, mark == F.col("_leaky"), "left_anti")


SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t-\r]+'), lambda x: x <> '') AS w
  FROM documents
), i AS (
  SELECT item_id, row_number() OVER () AS r,
         list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t-\r]+'), lambda x: x <> '') AS w
  FROM benchmark
), ds AS (
  SELECT doc_id, r, unnest(generate_series(0, greatest(len(w) - 5, 0))) AS p, w FROM d WHERE len(w) > 0
), dh AS (SELECT doc_id, r, p, array_to_string(w[p + 1 : p + 5], ' ') AS h FROM ds
), ish AS (
  SELECT item_id, r, unnest(generate_series(0, greatest(len(w) - 5, 0))) AS p, w FROM i WHERE len(w) > 0
), ih AS (SELECT item_id, r, p, array_to_string(w[p + 1 : p + 5], ' ') AS h FROM ish
), ic AS (SELECT item_id, r, h, count(*) AS c FROM ih GROUP BY ALL
), n AS (SELECT item_id, r, count(*) AS n FROM ih GROUP BY ALL
), total AS (SELECT r, max(p) + 1 AS t FROM dh GROUP BY r
), hit AS (
  SELECT dh.doc_id, dh.r, dh.p, ic.item_id, ic.r AS ir, dh.h, ic.c FROM dh JOIN ic ON dh.h = ic.h
), a AS (
  -- every window that holds a shingle of the item, wherever it starts
  SELECT doc_id, r, item_id, ir, p, bool_or(own) AS own FROM (
    SELECT hit.doc_id, hit.r, hit.item_id, hit.ir, unnest(generate_series(greatest(0, hit.p - n.n + 1), hit.p)) AS p,
           unnest(generate_series(greatest(0, hit.p - n.n + 1), hit.p)) = hit.p AS own
    FROM hit JOIN n ON n.r = hit.ir
  ) GROUP BY ALL
), win AS (
  SELECT a.doc_id, a.r, a.item_id, a.ir, a.p, a.own, b.h, least(count(*), any_value(b.c)) AS o
  FROM a JOIN n ON n.r = a.ir
  JOIN hit b ON a.r = b.r AND a.ir = b.ir AND b.p >= a.p AND b.p < a.p + n.n
  GROUP BY a.doc_id, a.r, a.item_id, a.ir, a.p, a.own, b.h
), sim AS (
  SELECT win.doc_id, win.item_id, win.p, any_value(own) AS own, sum(o) AS o, any_value(n.n) AS n,
         any_value(least(n.n, total.t - win.p)) AS s
  FROM win JOIN n ON n.r = win.ir JOIN total ON total.r = win.r
  GROUP BY win.doc_id, win.r, win.item_id, win.ir, win.p
), good AS (
  SELECT doc_id, item_id, CAST(o AS DOUBLE) / CAST(n + s - o AS DOUBLE) AS similarity, own, p, s FROM sim
)
SELECT doc_id, item_id, similarity, CAST(p AS INTEGER) AS start, CAST(s AS INTEGER) AS words FROM good
WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, own DESC, p, s DESC) = 1
"""

"""Near dedup of the pipeline: word shingles, prefix filter, exact Jaccard similarity.

Two sets of shingles alike in SIMILARITY share one of their first shingles under any common order: the
first ``n - ceil(SIMILARITY * n) + 1`` of ``n``. Rare shingles come first, so that documents meet over
what few others hold. Documents that share such a shingle are compared whole. Each is compared with
one representative of each of its cells first; only pairs that this leaves in different components
are then compared one by one, which keeps a large group of copies linear.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegraph.llm.common import durable, scratch, trim
from notegraph.llm.components import connected

WORDS = 5
SIMILARITY = 0.8
#: Documents whose shingles are counted to tell common ones, and the most common ones that are told.
#: Neither changes which pairs are found, since any order will do.
SAMPLE = 1 << 14
COMMON = 1 << 17
SLICE = 256
SPREAD = 64
#: Longs of the sketch of a set of shingles, a power of two.
SKETCH = 8
FEW = 1 << 17


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of the ``words``-word shingles of ``text``, ascending. Fewer words make one
    shingle; so do none, and texts without words are alike."""
    tokens = text.split()
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(joined)], dtype=np.uint64).view(np.int64)
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    digest = xxhash.xxh64_intdigest
    n = len(tokens) - words + 1
    found = np.fromiter(
        (digest(joined[a:b]) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist(), strict=True)), dtype=np.uint64, count=n
    )
    return np.unique(found.view(np.int64))


def _bytes(value: pa.Scalar) -> bytes:
    return value.as_buffer().to_pybytes() if value.is_valid else b""


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices, since the shingles of a text take more room than the text."""
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE):
            yield batch.slice(k, SLICE)
    trim()


def _few(rows: DataFrame) -> DataFrame:
    """``rows``, to be sent whole where they are few: the larger side of a join then stays where it is."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def sketch(own: np.ndarray, longs: int) -> np.ndarray:
    """64 * ``longs`` bits, a power of two: whether an odd number of the shingles falls on each."""
    odd = np.bincount(own & (64 * longs - 1), minlength=64 * longs) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate(rows)))


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """(mark, own, sketch, wide) for each row (mark, text): its set of shingles, and two sketches of it, one of
    SKETCH longs and one that has as many bits as the set shingles at least."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            own = [shingles(_bytes(x), words) for x in batch.column(1)]
            wide = [max(SKETCH, 1 << (max(1, len(x) // 64) - 1).bit_length()) for x in own]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _lists(own), _lists([sketch(x, SKETCH) for x in own]), _lists([sketch(x, n) for x, n in zip(own, wide, strict=True)])],
                ["mark", "own", "sketch", "wide"],
            )

    return texts.mapInArrow(each, "mark long, own array<long>, sketch array<long>, wide array<long>")


def _changed(x: str, y: str) -> Column:
    """Bits in which two sketches differ. The longer one is folded: what falls on bit ``i`` of the shorter falls on
    ``i`` or that many further on of the longer."""

    def folded(one: str, other: str) -> Column:
        half = F.size(other)
        twice = F.zip_with(F.slice(one, 1, half), F.slice(one, half + 1, half), lambda a, b: a.bitwiseXOR(b))
        return F.when(F.size(one) == 2 * half, twice).otherwise(F.col(one))

    bits = F.zip_with(folded(x, y), folded(y, x), lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    return F.aggregate(bits, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0)))


def _common(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that are most common in a sample, ascending, and in how many of its documents they are."""
    share = max(1, texts.count() // SAMPLE)
    sample = _sets(texts.where(F.pmod("mark", F.lit(share)) == 0), words)
    found = sample.select(F.explode("own").alias("h")).groupBy("h").count().where("count > 2")
    top = found.orderBy(F.desc("count"), "h").limit(COMMON).toArrow()
    h, n = (np.array(top.column(c), dtype=np.int64) for c in ("h", "count"))
    order = np.argsort(h)
    del top
    trim()
    return h[order], n[order]


def _needed(n: int, similarity: float) -> int:
    return int(np.ceil(similarity * n - 1e-9))


def prefix(own: np.ndarray, common: np.ndarray, times: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The first shingles of ``own``, rare ones before common ones: sets alike in ``similarity`` share one."""
    rank = np.zeros(len(own), dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        rank = np.where(common[at] == own, times[at], 0)
    return own[np.lexsort((own, rank))[: len(own) - _needed(len(own), similarity) + 1]]


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets are alike in ``similarity``: by their wide sketches first, which are a
    sixty-fourth of the sets. Sketches of sets alike differ in no more bits than the sets in shingles."""
    both = lambda rows, *cols: rows.join(
        sets.select(F.col("mark").alias("a"), *[c.alias(f"x{i}") for i, c in enumerate(cols)]), "a"
    ).join(sets.select(F.col("mark").alias("b"), *[c.alias(f"y{i}") for i, c in enumerate(cols)]), "b")
    near = both(pairs, F.col("wide"), F.size("own"))
    near = near.where(_changed("x0", "y0") <= (F.col("x1") + F.col("y1")) * ((1 - similarity) / (1 + similarity)) + 1e-6)
    shared = F.size(F.array_intersect("x0", "y0"))
    return (
        both(durable(near.select("a", "b")), F.col("own"))
        .where(shared >= similarity * (F.size("x0") + F.size("y0") - shared) - 1e-9)
        .select("a", "b")
    )


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (h, mark, n, at, common) sorted by ``h`` and ``mark``, those whose ``h`` has two marks or more, once
    each, and all common ones. Nearly all have one, so an aggregate and a join don't pay. One row is held back."""
    held: list[np.ndarray] = []  # the last row, if its h has no second mark yet
    prior: tuple[int, int] | None = None
    open_, last_h = False, 0  # whether the last h has been met
    for batch in batches:
        if not batch.num_rows:
            continue
        got = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
        if held:
            got = [np.append(x, y) for x, y in zip(held, got, strict=True)]
        h, mark, common = got[0], got[1], got[4]
        new = np.append(True, (h[1:] != h[:-1]) | (mark[1:] != mark[:-1]))
        if prior is not None and not held:
            new[0] = (int(h[0]), int(mark[0])) != prior
        prior = int(h[-1]), int(mark[-1])
        last = h == h[-1]
        same = np.append(h[1:] == h[:-1], False)
        other = same & np.append(mark[1:] != mark[:-1], False)
        # An h is met if any two neighbours of it differ in their marks, or it was before.
        edge = np.append(0, np.flatnonzero(~same[:-1]) + 1)
        met = np.logical_or.reduceat(other, edge)
        met[0] |= open_ and last_h == int(h[0])
        whole = np.repeat(met, np.diff(np.append(edge, len(h)))) | common
        keep = whole & new
        wait = not whole[-1]
        open_, last_h = bool(met[-1]), int(h[-1])
        held = [x[-1:].copy() for x in got] if wait else []
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in got[:4]], ["h", "mark", "n", "at"])


def _may(n: str, at: str, m: str, to: str, similarity: float) -> Column:
    """Whether two sets of ``n`` and ``m`` shingles whose first common one has the places ``at`` and ``to`` may be alike:
    what follows it in the shorter rest bounds what they share."""
    most = F.least(F.col(n) - F.col(at), F.col(m) - F.col(to))
    return most >= (F.col(n) + F.col(m)) * (similarity / (1 + similarity)) - 1e-6


def alike(texts: DataFrame, pairs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Those of the pairs (a, b) of marks of the rows (mark, text) whose texts are alike in ``similarity``."""
    return _alike(pairs, _of(texts, pairs, words), similarity)


def _open(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """The pairs (a, b) that ``edges`` leave in different components."""
    roots = _few(connected(edges))
    root = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}r"))
    placed = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left")
    return placed.where(F.coalesce("ar", "a") != F.coalesce("br", "b")).select("a", "b")


def links(texts: DataFrame, known: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Edges (a, b) between marks of the rows (mark, text) such that exactly those are connected whose
    Jaccard similarity is ``similarity`` or more, directly or over others. ``known``: edges between such pairs
    that have been found already; what they connect is not compared again."""
    common, times = _common(texts, words)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            own = [shingles(_bytes(x), words) for x in batch.column(1)]
            firsts = [prefix(x, common, times, similarity) for x in own]
            lengths = [len(x) for x in firsts]
            every = np.concatenate(firsts)
            marks = np.repeat(batch.column(0).to_numpy(), lengths)
            sizes = np.repeat(np.array([len(x) for x in own], dtype=np.int32), lengths)
            at = np.concatenate([np.arange(n, dtype=np.int32) for n in lengths])
            known = common[np.minimum(np.searchsorted(common, every), len(common) - 1)] == every if len(common) else np.zeros(len(every), dtype=bool)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (every, marks, sizes, at, known)], ["h", "mark", "n", "at", "common"])

    cells = texts.mapInArrow(each, "h long, mark long, n int, at int, common boolean")
    # Common shingles need no second holder to be found, so their rows are spread.
    spread = cells.repartition("h", F.when(F.col("common"), F.pmod("mark", F.lit(SPREAD))).otherwise(0))
    shared = durable(spread.sortWithinPartitions("h", "mark").mapInArrow(_met, "h long, mark long, n int, at int"))
    # Representatives of a cell: the document with the fewest shingles before the common one, which is the original of
    # many copies if they have been changed, and one by chance, so that a large group has many.
    who = ("mark", "n", "at")
    by = F.xxhash64("mark", "h").alias("by")
    chosen = shared.groupBy("h").agg(F.min(F.struct("at", by, *who[:2])).alias("c"), F.min(F.struct(by, *who)).alias("d"))
    of = lambda x: F.struct(*[F.col(f"{x}.{c}") for c in who])
    chosen = durable(chosen.select("h", F.array(of("c"), of("d")).alias("chosen")))
    ordered = (F.least("mark", "other").alias("a"), F.greatest("mark", "other").alias("b"))
    stars = durable(
        shared.join(chosen, "h")
        .select("mark", "n", "at", F.explode("chosen").alias("c"))
        .select("mark", "n", "at", F.col("c.mark").alias("other"), F.col("c.n").alias("m"), F.col("c.at").alias("to"))
        .where((F.col("mark") != F.col("other")) & _may("n", "at", "m", "to", similarity))
        .select(*ordered)
        .distinct()
    )
    spark = texts.sparkSession
    with scratch(spark) as keep:
        edges = keep(known.unionByName(alike(texts, durable(_open(stars, known)), words, similarity)))
    with scratch(spark) as keep:
        mixed = keep(_mixed(shared, edges))
    sets = _of(texts, mixed.select(F.col("mark").alias("a"), F.col("mark").alias("b")), words)
    rest = durable(_apart(mixed, sets, stars, similarity))
    return edges.unionByName(_alike(rest, sets, similarity))


def _of(texts: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """The sets of the marks in ``pairs``."""
    marks = durable(pairs.select(F.explode(F.array("a", "b")).alias("mark")).distinct())
    return durable(_sets(texts.join(_few(marks), "mark", "left_semi").select("mark", "text").dropDuplicates(["mark"]), words))


def _mixed(shared: DataFrame, edges: DataFrame) -> DataFrame:
    """(h, mark, n, at, root, major) of the rows of ``shared`` (h, mark, n, at) whose cell has several components of
    ``edges``: their own, and that which has most of the cell."""
    roots = connected(edges)
    placed = durable(
        shared.join(roots, shared.mark == roots.node, "left").select("h", "mark", "n", "at", F.coalesce("root", "mark").alias("root"))
    )
    per = placed.groupBy("h", "root").count()
    major = durable(
        per.groupBy("h").agg(F.max(F.struct("count", "root")).alias("m"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("h", F.col("m.root").alias("major"))
    )
    return placed.join(major, "h")


def _apart(mixed: DataFrame, sets: DataFrame, stars: DataFrame, similarity: float) -> DataFrame:
    """The pairs of ``mixed`` that may be alike, are not compared yet, and are not in one component. Of two such, one
    at least is not in the component that has most of the cell. Every shingle that one of two sets has alone
    changes one bit of its sketch, so sketches that differ in more bits than that belong to unlike sets."""
    marked = durable(mixed.join(sets.select("mark", "sketch"), "mark"))
    named = lambda x: [F.col("mark").alias(x), F.col("n").alias(f"{x}n"), F.col("at").alias(f"{x}at"), F.col("root").alias(f"{x}r"), F.col("sketch").alias(f"{x}s")]
    small = marked.where("root <> major").select("h", *named("p"))
    every = marked.select("h", *named("q"), (F.col("root") == F.col("major")).alias("in_major"))
    changed = sum((F.bit_count(F.get("ps", F.lit(i)).bitwiseXOR(F.get("qs", F.lit(i)))) for i in range(1, SKETCH)), F.bit_count(F.get("ps", F.lit(0)).bitwiseXOR(F.get("qs", F.lit(0)))))
    met = small.join(every, "h").where(
        (F.col("pr") != F.col("qr"))
        & (F.col("in_major") | (F.col("p") < F.col("q")))
        & _may("pn", "pat", "qn", "qat", similarity)
        & (changed <= (F.col("pn") + F.col("qn")) * ((1 - similarity) / (1 + similarity)) + 1e-6)
    )
    return met.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")


def unique(
    docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, found: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """The rows of ``docs`` that come first in their component: that with the smallest doc_id, null ones
    last, and of rows with one doc_id that with the smallest hash of the text.

    Two texts are linked if the Jaccard similarity of their sets of ``words``-word shingles, lower-cased,
    is ``similarity`` or more. Texts without words, empty ones and nulls are linked. Rows repeated whole
    stay repeated. ``found``: gives edges between rows (mark, text) that are alike; the rest is looked for here.
    """
    text = F.coalesce("text", F.lit(""))
    mark = F.xxhash64(text)
    texts = docs.select(mark.alias("mark"), F.lower(text).cast("binary").alias("text"))
    spark = docs.sparkSession
    with scratch(spark) as keep:
        with scratch(spark) as hold:
            known = hold(found(texts) if found else spark.createDataFrame([], "a long, b long"))
        roots = connected(links(texts, known, words, similarity))
        keys = docs.select(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", mark.alias("mark")).alias("k"))
        placed = durable(
            keys.join(roots, F.col("k.mark") == F.col("node"), "left").select("k", F.coalesce("root", "k.mark").alias("root")).distinct()
        )
        first = durable(placed.groupBy("root").agg(F.min("k").alias("first"), F.max("k").alias("other")).where("first <> other").drop("other"))
        later = keep(placed.join(first, "root").where("k <> first").select(F.col("k.doc_id").alias("_id"), F.col("k.mark").alias("_mark")))
    return docs.join(_few(later), F.col("doc_id").eqNullSafe(F.col("_id")) & (mark == F.col("_mark")), "left_anti")

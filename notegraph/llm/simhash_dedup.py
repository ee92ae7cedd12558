"""SimHash near-dedup over a segment-popcount embedding.

A 64-bit fingerprint is mapped to the numbers of bits set in its 32 two-bit segments. The Manhattan
distance of two such vectors never exceeds the Hamming distance of the fingerprints, so it prunes
without loss. The 32 axes are dealt to groups; a pair within Manhattan distance 2 differs in at most
two groups, so it shares a grid cell on the axes of the others. Fingerprints are joined by those cells,
pruned by the Manhattan bound, and verified by their exact Hamming distance. What crowds a cell is
dealt again on a finer grid of more groups, whose cells agree in more axes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegraph.llm import shingle_dedup
from notegraph.llm.common import durable, trim
from notegraph.llm.components import connected

RADIUS = 2
#: Groups of the grids, coarse to fine: cells agree in 19, 28 and 30 of 32 axes.
GROUPS = (5, 16, 32)
#: Fingerprints that a cell may have for its pairs to be compared. Those that crowd all cells they share are alike
#: in the bit counts of 30 segments, which no grid tells apart, and are linked through one-bit neighbours.
CELL = 64
_STEP = 1 << 15
_LOW = 0x5555555555555555


def fingerprint(text: bytes, words: int = 3) -> int:
    """SimHash of the ``words``-word shingles of ``text``, A-Z lower-cased; no words: zero."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(tokens) - words + 1)
    last = ends[min(words, len(tokens)) - 1 :]
    set_bits = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, _STEP):
        m = min(n, k + _STEP)
        hashes = np.fromiter(
            (digest(joined[a:b], 42) for a, b in zip(starts[k:m].tolist(), last[k:m].tolist(), strict=True)),
            dtype=np.uint64,
            count=m - k,
        )
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp) for each row; a null text counts as empty and has fingerprint zero."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter(
                (fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", words) for x in batch.column(1)),
                dtype=np.uint64,
                count=batch.num_rows,
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])
        trim()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(each, "doc_id long, fp long")


def unary(fp: Column) -> Column:
    """Each two-bit segment's popcount in unary (00, 01, 11), so that the Hamming distance of two
    such values is the Manhattan distance of the popcount vectors."""
    low = F.lit(_LOW)
    half = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(half).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(half).bitwiseAND(low), 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def axis_masks(groups: int, radius: int = RADIUS) -> list[int]:
    """Masks of the axes that remain when any ``radius`` groups of segments are left out."""
    edges = [32 * g // groups for g in range(groups + 1)]
    parts = [sum(3 << (2 * s) for s in range(edges[g], edges[g + 1])) for g in range(groups)]
    return [_signed(sum(kept)) for kept in combinations(parts, groups - radius)]


def links(points: DataFrame, radius: int = RADIUS, groups: tuple[int, ...] = GROUPS, cell: int = CELL) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` such that exactly those within ``radius`` differing bits
    are connected: every such pair that shares a cell of up to ``cell`` fingerprints in one of the grids, and
    a chain of those that share a one-bit neighbour among fingerprints whose cells are all larger. ``radius``
    must be 2 for the latter: two fingerprints have a common one-bit neighbour if and only if they differ in
    at most 2."""
    if radius != 2:
        raise ValueError("crowded cells need radius 2")
    apart = lambda x, y: F.bit_count(x.bitwiseXOR(y))
    found, rest = [], points
    for n in groups:
        keys = [F.xxhash64(F.lit(i), unary(F.col("fp")).bitwiseAND(F.lit(m))) for i, m in enumerate(axis_masks(n, radius))]
        cells = rest.select("fp", F.explode(F.array(*keys)).alias("cell"))
        # Written, so that the join has two plain exchanges and the rows of a large cell can be split.
        sizes = durable(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
        shared = durable(cells.join(sizes, "cell"))
        small = shared.where(F.col("size") <= cell).select("cell", "fp")
        found.append(
            small.withColumnRenamed("fp", "a")
            .join(small.withColumnRenamed("fp", "b"), "cell")
            .where(F.col("a") < F.col("b"))
            .where(apart(unary(F.col("a")), unary(F.col("b"))) <= radius)
            .where(apart(F.col("a"), F.col("b")) <= radius)
            .select("a", "b")
        )
        rest = durable(shared.where(F.col("size") > cell).select("fp").distinct())
        if rest.isEmpty():
            break
    flips = [F.col("fp").bitwiseXOR(F.lit(_signed(1 << k))) for k in range(64)]
    near = rest.select("fp", F.explode(F.array(F.col("fp"), *flips)).alias("middle"))
    least = near.groupBy("middle").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    found.append(near.join(least, "middle").where("fp != b").select(F.col("fp").alias("a"), "b"))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.distinct()


def near_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 3,
    radius: int = RADIUS,
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``.

    ``fingerprint`` is 16 lowercase hex digits; ``component_id`` is the smallest doc_id reachable over
    links of at most ``radius`` differing bits. Rows with equal fingerprints are linked. Texts without
    words, empty ones and nulls have fingerprint zero and are linked like any others. Null identifiers
    keep their row but are never a ``component_id`` unless a component has no other. Repeated rows stay
    repeated; other columns are ignored; an empty table gives an empty result.
    """
    marks = durable(fingerprints(docs, id_col, text_col, words))
    points = durable(marks.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected(links(points, radius))
    grouped = points.join(roots, points.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = grouped.join(least, "root").select("fp", "component_id")
    return marks.join(classes, "fp", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def alike(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Edges (a, b) between marks of the rows (mark, text): texts of one fingerprint with the first of them, and the
    first ones of fingerprints that the grid join links, each pair verified by its sets of shingles."""
    marks = durable(fingerprints(texts, "mark", "text", words).withColumnRenamed("doc_id", "mark").distinct())
    points = durable(marks.groupBy("fp").agg(F.min("mark").alias("first")))
    same = marks.join(points, "fp").where("mark <> first").select(F.col("first").alias("a"), F.col("mark").alias("b"))
    point = lambda x: points.select(F.col("fp").alias(x), F.col("first").alias(f"{x}m"))
    near = links(points.select("fp")).join(point("a"), "a").join(point("b"), "b")
    pairs = same.unionByName(near.select(F.least("am", "bm").alias("a"), F.greatest("am", "bm").alias("b")))
    return shingle_dedup.alike(texts, durable(pairs), words, similarity)


def unique(docs: DataFrame, words: int = shingle_dedup.WORDS, similarity: float = shingle_dedup.SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that the pipeline keeps of near copies: those that fingerprints and the grid join find,
    verified; and, since texts alike in ``similarity`` may differ in more bits than the grid spans, those that are
    left, by shared shingles."""
    return shingle_dedup.unique(docs, words, similarity, lambda texts: alike(texts, words, similarity))

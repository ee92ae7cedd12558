"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of words, of their first 4 to 7 bytes, of pairs of neighbouring words and of
pairs with one word between, hashed to 2**BITS slots. Per-coordinate rates and the L1 term leave few
weights, which every task gets as two small arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notegraph.llm import ngrams
from notegraph.llm.common import durable, named, trim

BITS = 20
#: The model is fitted on about this many labelled documents, chosen by a hash of their identifier, and on fewer
#: where their features take more bytes than TRAIN_BYTES.
TRAIN_DOCS, TRAIN_BYTES = 6000, 1 << 29
THRESHOLD = 0.3
#: Lengths in bytes of the beginnings of words that are features: one stem has many endings.
STEMS = (4, 5, 6, 7)


def features(words: np.ndarray, stems: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot, row) of every feature, repeats included."""
    shift = np.uint64(64 - BITS)
    one, two = row[:-1] == row[1:], row[:-2] == row[2:]
    a, b = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
    pair = ngrams.mix(words[:-1][one] * a + words[1:][one])
    skip = ngrams.mix(words[:-2][two] * b + words[2:][two])
    slots = np.concatenate([x >> shift for x in (words, *stems, pair, skip)])
    return slots.astype(np.int64), np.concatenate([row] * (1 + len(stems)) + [row[:-1][one], row[:-2][two]])


def fit(
    rows: list[np.ndarray],
    labels: np.ndarray,
    epochs: int = 4,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 12.0,
    l2: float = 0.5,
    positive: float = 1.0,
) -> tuple[np.ndarray, float]:
    """Weights by slot and the intercept. ``rows``: the slots present in each document; ``positive``:
    the weight of a document with label 1. Without rows of both labels only the intercept is fitted."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias, seen = 0.0, 1.0
    both = len(set(labels.tolist())) > 1
    for _ in range(epochs if len(rows) else 0):
        for x, y in zip(rows, labels, strict=True):
            zx, nx = z[x], n[x]
            w = -(zx - np.sign(zx) * l1) / ((beta + np.sqrt(nx)) / alpha + l2) * (np.abs(zx) > l1)
            p = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35)))
            g = (p - y) * (positive if y else 1.0)
            seen += g * g
            bias -= 0.5 * g / np.sqrt(seen)
            if both:
                more = nx + g * g
                z[x] = zx + g - (np.sqrt(more) - np.sqrt(nx)) / alpha * w
                n[x] = more
    w = -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2) * (np.abs(z) > l1)
    return w, bias


def _share(share: float, seed: int) -> Column:
    """Whether a row is in a ``share`` of all, chosen by a hash of doc_id."""
    return F.xxhash64("doc_id", F.lit(seed)).bitwiseAND(F.lit((1 << 63) - 1)) <= int(((1 << 63) - 1) * share)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(doc_id, text, y) of about ``limit`` labelled documents at most. Labels are combined by
    maximum where a document has several, and so are texts by minimum, before they are shuffled; null
    identifiers and labels are left out."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col(label).cast("int")).alias("y"))
    )
    total = known.count()
    if total > limit:
        known = known.where(_share(limit / total, 5))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: list[bytes] = []
        for _, rows, words, stems, row in ngrams.word_groups(batch.column(1), STEMS):
            slot, own = features(words, stems, row)
            keys = np.unique((own << BITS) | slot)
            cuts = np.searchsorted(keys, np.arange(rows + 1) << BITS)
            slots = (keys & ((1 << BITS) - 1)).astype(np.uint32)
            found += [slots[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(found, pa.binary())], ["doc_id", "y", "slots"]
        )


def collected(rows: DataFrame, most: int = TRAIN_BYTES) -> list[dict]:
    """The training rows (doc_id, y, slots) in a fixed order, about ``most`` bytes of them at most."""
    rows = durable(rows)
    size = rows.agg(F.sum(F.octet_length("slots"))).first()[0] or 0
    got = (rows if size <= most else rows.where(_share(most / size, 6))).toArrow().to_pylist()
    return sorted(got, key=lambda r: (r["doc_id"] * 0x9E3779B97F4A7C15 % (1 << 64), r["slots"]))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = TRAIN_DOCS) -> tuple[np.ndarray, float]:
    rows = training_rows(docs, labels, label, limit).select("doc_id", F.col("text").cast("binary"), "y")
    got = collected(rows.mapInArrow(_slots, "doc_id long, y int, slots binary"))
    # The slots stay where they came; wider copies of all rows would take the driver twice as much again.
    model = fit([np.frombuffer(r["slots"], dtype=np.uint32) for r in got], np.array([r["y"] for r in got], dtype=float))
    del got
    trim()
    return model


def score(
    docs: DataFrame,
    model: tuple[np.ndarray, float],
    columns: tuple[str, ...] = ("doc_id",),
    text_col: str = "text",
    below: float | None = None,
) -> DataFrame:
    """``columns`` of each row and ``score``: the probability of label 1 for the whole text. With
    ``below``, the rows scored under it alone and no score. Null and empty texts get the score of the
    intercept. Other columns are ignored; an empty table gives none."""
    weights, bias = model
    at = np.flatnonzero(weights)
    sent = docs.sparkSession.sparkContext.broadcast((at, weights[at].astype(np.float32), float(bias)))
    # Arrow functions don't take names with dots, so the columns go by their places.
    places = [named(c).alias(f"c{i}") for i, c in enumerate(columns)]
    rows = docs.select(*places, F.col(text_col).cast("binary").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values, bias = sent.value
        dense = np.zeros(1 << BITS, dtype=np.float32)
        dense[at] = values
        for batch in batches:
            sums = np.full(batch.num_rows, bias)
            for first, n, words, stems, row in ngrams.word_groups(batch.column(batch.num_columns - 1), STEMS):
                slot, own = features(words, stems, row)
                hit = dense[slot] != 0
                keys = np.unique((own[hit] << BITS) | slot[hit])
                sums[first : first + n] += np.bincount(
                    keys >> BITS, weights=dense[keys & ((1 << BITS) - 1)], minlength=n
                )
            found = 1 / (1 + np.exp(-np.clip(sums, -35, 35)))
            kept, names = list(batch.columns[:-1]), batch.schema.names[:-1]
            if below is None:
                yield pa.RecordBatch.from_arrays([*kept, pa.array(found)], [*names, "score"])
            else:
                yield pa.RecordBatch.from_arrays(kept, names).filter(pa.array(found < below))
        trim()

    schema = T.StructType(rows.schema.fields[:-1])
    if below is not None:
        return rows.mapInArrow(each, schema).toDF(*columns)
    return rows.mapInArrow(each, schema.add("score", T.DoubleType())).toDF(*columns, "score")


def fold_of(id_col: str, folds: int):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def learn(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> tuple[np.ndarray, float]:
    """The model of the rows of ``labels`` that are not held out: those whose crc32(doc_id) mod 4 is not 2."""
    return train(docs, labels.where(fold_of("doc_id", 4) != 2), "toxic", limit)


def toxicity(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``. Held-out rows teach nothing. A
    null identifier is not held out and has no label; repeated rows are scored each."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return score(rows, learn(docs, labels, limit)).select(
        "doc_id",
        F.coalesce(fold_of("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    return score(docs, learn(docs, labels), tuple(docs.columns), below=THRESHOLD)

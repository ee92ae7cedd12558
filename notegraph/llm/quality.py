"""Quality by Naive Bayes support vectors over hashed n-gram indicators.

The indicators are words, pairs of neighbouring words, runs of three bytes, and which neighbours are
equal among four words, hashed to 2**BITS slots. Each is scaled by the log ratio of its smoothed frequencies in the two classes; a linear
hinge-loss model over the scaled indicators is fitted by dual coordinate descent, and its margin is
turned into a probability by a logistic curve fitted on documents the descent has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notegraph.llm import ngrams
from notegraph.llm.common import named
from notegraph.llm.toxicity import collected, fold_of, training_rows

BITS = 18
#: The model is fitted on about this many labelled documents, chosen by a hash of their identifier, and on fewer
#: where their features take more than the bytes that toxicity.collected allows.
TRAIN_DOCS = 4000
THRESHOLD = 0.3


def slots_of(column: pa.Array, shapes: bool = True) -> Iterator[np.ndarray]:
    """The distinct slots of each row of a binary column. Null counts as empty."""
    shift = np.uint64(64 - BITS)
    place = np.zeros(1 << BITS, dtype=np.int64)
    for first, rows, words, _, row in ngrams.word_groups(column):
        cuts = np.searchsorted(row, np.arange(rows + 1))
        for k in range(rows):
            own = words[cuts[k] : cuts[k + 1]]
            pairs = ngrams.mix(own[:-1] * np.uint64(0xBF58476D1CE4E5B9) + own[1:])
            cell = column[first + k]
            # Which neighbours are equal, over runs of four words: an n-gram of repetition shapes.
            same = (own[1:] == own[:-1]).astype(np.uint64)
            shape = ngrams.mix(same[:-2] * np.uint64(4) + same[1:-1] * np.uint64(2) + same[2:] + np.uint64(1 << 40))
            parts = [own >> shift, pairs >> shift, *([shape >> shift] if shapes else [])]
            if cell.is_valid:
                raw = np.frombuffer(cell.as_buffer(), dtype=np.uint8)
                # Windows of a long text are taken in pieces; the slots of a piece are few.
                for a in range(0, max(0, len(raw) - 2), ngrams.CHUNK):
                    b = raw[a : a + ngrams.CHUNK + 2].astype(np.uint64)
                    three = b[:-2] | (b[1:-1] << np.uint64(8)) | (b[2:] << np.uint64(16))
                    part = three * np.uint64(0x9E3779B97F4A7C15) >> shift
                    parts.append(part if len(raw) <= ngrams.CHUNK else np.unique(part))
            found = np.concatenate(parts).astype(np.int64)
            order = np.arange(len(found))
            place[found] = order  # the last occurrence of each slot
            yield found[place[found] == order]


def log_ratios(rows: list[np.ndarray], labels: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log((p / |p|) / (q / |q|)) by slot; slots in fewer than two documents get 0."""
    count = np.zeros((2, 1 << BITS))
    for x, y in zip(rows, labels, strict=True):
        count[int(y), x] += 1
    p, q = count[1] + smooth, count[0] + smooth
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    return np.where(count.sum(axis=0) >= 2, ratio, 0.0)


def descend(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, cost: float = 1.0, epochs: int = 12) -> np.ndarray:
    """Weights of the scaled indicators, by dual coordinate descent on the hinge loss. The cost of an
    example is inverse to the frequency of its class. Slot 2**BITS is the intercept."""
    w = np.zeros((1 << BITS) + 1)
    sign = np.where(labels > 0, 1.0, -1.0)
    share = {s: max(1, int((sign == s).sum())) for s in (1.0, -1.0)}
    most = [cost * len(rows) / (2 * share[s]) for s in sign]
    alpha = np.zeros(len(rows))
    values = [np.append(scale[x], 1.0) for x in rows]
    index = [np.append(x, 1 << BITS) for x in rows]
    norm = [float(v @ v) for v in values]
    draw = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in draw.permutation(len(rows)):
            x, v = index[i], values[i]
            slope = sign[i] * float(w[x] @ v) - 1
            now = min(max(alpha[i] - slope / norm[i], 0.0), most[i])
            if now != alpha[i]:
                w[x] += (now - alpha[i]) * sign[i] * v
                moved = max(moved, abs(now - alpha[i]) * norm[i])
                alpha[i] = now
        if moved < 1e-3:
            break
    w[:-1] *= scale
    return w


def calibrate(margins: np.ndarray, labels: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """(a, b) of the logistic curve 1 / (1 + exp(-(a m + b))), by Newton's method with targets drawn
    in from 0 and 1."""
    if not len(margins):
        return 1.0, 0.0
    n1 = labels.sum()
    n0 = len(labels) - n1
    goal = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    spread = margins.std() or 1.0
    x = np.stack([margins / spread, np.ones(len(margins))], axis=1)
    theta = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -35, 35)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        theta -= np.clip(np.linalg.solve(h, x.T @ (p - goal) + 1e-3 * theta), -2, 2)
    return max(float(theta[0]), 1e-3) / spread, float(theta[1])


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0) -> tuple[np.ndarray, float, float]:
    """Weights by slot with the intercept last, and the curve. One in four rows is kept for the curve,
    after which the weights are fitted again on all rows. Without rows of both labels every score is
    the share of label 1, or one half without rows."""
    if len(set(labels.tolist())) < 2:
        share = (float(labels.sum()) + 1) / (len(labels) + 2)
        return np.zeros((1 << BITS) + 1), 1.0, float(np.log(share / (1 - share)))
    apart = np.zeros(len(rows), dtype=bool)
    for y in (0, 1):
        apart[np.flatnonzero(labels == y)[::4]] = True
    part = [x for x, out in zip(rows, apart, strict=True) if not out]
    if len(set(labels[~apart].tolist())) < 2:
        part, apart = rows, np.ones(len(rows), dtype=bool)
        seen = labels
    else:
        seen = labels[~apart]
    w = descend(part, seen, log_ratios(part, seen), cost)
    margins = np.array([w[x].sum() + w[-1] for x, out in zip(rows, apart, strict=True) if out])
    a, b = calibrate(margins, labels[apart])
    return descend(rows, labels, log_ratios(rows, labels), cost), a, b


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [x.astype(np.uint32).tobytes() for x in slots_of(batch.column(1))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(found, pa.binary())], ["doc_id", "y", "slots"]
        )


def learn(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> tuple[np.ndarray, float, float]:
    """The model of the rows of ``labels`` that are not held out: those whose crc32(doc_id) mod 5 is not 0."""
    known = labels.where(fold_of("doc_id", 5) != 0)
    rows = training_rows(docs, known, "quality", limit).select("doc_id", F.col("text").cast("binary"), "y")
    got = collected(rows.mapInArrow(_training, "doc_id long, y int, slots binary"))
    return fit(
        [np.sort(np.frombuffer(r["slots"], dtype=np.uint32).astype(np.int64)) for r in got],
        np.array([r["y"] for r in got], dtype=float),
    )


def score(docs: DataFrame, model: tuple[np.ndarray, float, float], columns: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``columns`` of each row and ``score``, the probability of label 1 for the whole text. Null and
    empty texts get the score of the intercept. Other columns are ignored; an empty table gives none."""
    sent = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), *model[1:]))
    # Arrow functions don't take names with dots, so the columns go by their places.
    places = [named(c).alias(f"c{i}") for i, c in enumerate(columns)]
    rows = docs.select(*places, F.col(text_col).cast("binary").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, a, b = sent.value
        for batch in batches:
            margins = np.fromiter(
                (float(w[x].sum(dtype=np.float64)) + float(w[-1]) for x in slots_of(batch.column(batch.num_columns - 1))),
                dtype=np.float64,
                count=batch.num_rows,
            )
            found = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(found)], [*batch.schema.names[:-1], "score"]
            )

    schema = T.StructType(rows.schema.fields[:-1])
    return rows.mapInArrow(each, schema.add("score", T.DoubleType())).toDF(*columns, "score")


def quality(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``. Held-out rows teach nothing. A
    null identifier is not held out and has no label; repeated rows are scored each."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return score(rows, learn(docs, labels, limit)).select(
        "doc_id",
        F.coalesce(fold_of("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )

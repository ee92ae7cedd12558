"""python -m tests.llm.crossval FOLDER: the constants of op1 and op6 compared by cross-validation.

Only labels of rows that are not held out are read: the others are dropped before anything else. Those
left are dealt to FOLDS parts by a hash of their own; each part is scored by a model of the others.
"""

from __future__ import annotations

import sys
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import xxhash

from notegraph.llm import ngrams, quality, toxicity

FOLDS = 3


def labelled(folder: str, label: str, mod: int, held_out: int, limit: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts, labels and parts of at most ``limit`` labelled rows that are not held out."""
    labels = ds.dataset(f"{folder}/labels.parquet").to_table(columns=["doc_id", label]).to_pylist()
    known = {x["doc_id"]: x[label] for x in labels if x["doc_id"] is not None and x[label] is not None and zlib.crc32(str(x["doc_id"]).encode()) % mod != held_out}
    order = sorted(known, key=lambda i: xxhash.xxh64_intdigest(str(i), 5))[:limit]
    docs = ds.dataset(f"{folder}/documents.parquet").to_table(columns=["doc_id", "text"], filter=ds.field("doc_id").isin(order)).to_pylist()
    texts = pa.array([(x["text"] or "").encode() for x in docs], pa.binary())
    part = np.array([xxhash.xxh64_intdigest(str(x["doc_id"]), 99) % FOLDS for x in docs])
    return texts, np.array([known[x["doc_id"]] for x in docs], dtype=float), part


def measure(scores: np.ndarray, y: np.ndarray) -> str:
    at = scores >= 0.3
    pairs = (scores[y == 1][:, None] > scores[y == 0][None]).mean() + 0.5 * (scores[y == 1][:, None] == scores[y == 0][None]).mean()
    loss = -np.mean(np.where(y > 0, np.log(np.clip(scores, 1e-9, 1)), np.log(np.clip(1 - scores, 1e-9, 1))))
    return f"accuracy {np.mean(at == (y > 0)):.4f}, of label 1 {at[y == 1].mean():.4f}, of label 0 {1 - at[y == 0].mean():.4f}, rank {pairs:.4f}, loss {loss:.4f}"


def toxic_rows(texts: pa.Array, stems: tuple[int, ...]) -> list[np.ndarray]:
    out = []
    for _, rows, words, begun, row in ngrams.word_groups(texts, stems):
        slot, own = toxicity.features(words, begun, row)
        keys = np.unique((own << toxicity.BITS) | slot)
        cuts = np.searchsorted(keys, np.arange(rows + 1) << toxicity.BITS)
        out += [keys[a:b] & ((1 << toxicity.BITS) - 1) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return out


def compare_toxicity(folder: str) -> None:
    texts, y, part = labelled(folder, "toxic", 4, 2, toxicity.TRAIN_DOCS)
    print("toxicity:", len(y), "rows,", int(y.sum()), "toxic", flush=True)
    for stems in ((), (4, 5, 6, 7)):
        rows = toxic_rows(texts, stems)
        for options in ({"l1": 4.0}, {"l1": 8.0}, {"l1": 8.0, "positive": 2.0}, {"l1": 12.0}, {"l1": 16.0}, {"l1": 24.0}, {"l1": 12.0, "epochs": 8}, {"l1": 12.0, "alpha": 0.3}, {"l1": 12.0, "l2": 0.1}):
            found = np.zeros(len(y))
            size = 0
            for k in range(FOLDS):
                w, bias = toxicity.fit([x for x, p in zip(rows, part, strict=True) if p != k], y[part != k], **({"positive": 1.0} | options))
                size += int((w != 0).sum())
                found[part == k] = [1 / (1 + np.exp(-np.clip(bias + w[x].sum(), -35, 35))) for x, p in zip(rows, part, strict=True) if p == k]
            print(stems, options, measure(found, y), "weights", size // FOLDS, flush=True)


def compare_quality(folder: str) -> None:
    texts, y, part = labelled(folder, "quality", 5, 0, quality.TRAIN_DOCS)
    print("quality:", len(y), "rows,", int(y.sum()), "good", flush=True)
    for shapes in (False, True):
        rows = [np.sort(x) for x in quality.slots_of(texts, shapes)]
        for cost in (0.1, 1.0, 3.0):
            found = np.zeros(len(y))
            for k in range(FOLDS):
                w, a, b = quality.fit([x for x, p in zip(rows, part, strict=True) if p != k], y[part != k], cost=cost)
                found[part == k] = [1 / (1 + np.exp(-np.clip(a * (w[x].sum() + w[-1]) + b, -35, 35))) for x, p in zip(rows, part, strict=True) if p == k]
            print("shapes" if shapes else "no shapes", cost, measure(found, y), flush=True)


if __name__ == "__main__":
    compare_toxicity(sys.argv[1])
    compare_quality(sys.argv[1])

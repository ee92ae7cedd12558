"""Chunks, embeddings and nearest neighbours (VS1-VS10, SL5)."""

from __future__ import annotations

import hashlib
import json
import subprocess
import urllib.request
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notegraph.errors import EngineError
from notegraph.functions import columns
from notegraph.operators.store import CHUNK_SCHEMA

Embedder = Callable[[list[str]], tuple[str, list[list[float]]]]


def chunked(versions: DataFrame) -> DataFrame:
    """(version_id, ix, text, text_hash); a blank body has none."""
    return versions.select(
        F.col("id").alias("version_id"), F.posexplode(columns.chunk_texts(F.coalesce("body", F.lit("")))).alias("ix", "text")
    ).withColumn("text_hash", F.sha2("text", 256))


def check_vectors(model: str, vectors: Sequence[Sequence[float]], count: int) -> None:
    """What an embedder must return: a vector for each text, all of one size."""
    if not model or len(vectors) != count or len({len(v) for v in vectors}) > 1 or any(not v for v in vectors):
        raise EngineError("semantic_unavailable", "the embedder broke its contract")


def http_embedder(url: str, timeout: float = 30) -> Embedder:
    """POST {"chunks": [...]}, answered by {"vectors": [...], "model": ...}."""

    def embed(texts: list[str]) -> tuple[str, list[list[float]]]:
        request = urllib.request.Request(url, json.dumps({"chunks": texts}).encode(), {"content-type": "application/json"})  # noqa: S310
        with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
            got = json.load(answer)
        return got["model"], got["vectors"]

    return embed


def command_embedder(command: Sequence[str], timeout: float = 60) -> Embedder:
    """One JSON line to the command's input for a batch, one line back."""

    def embed(texts: list[str]) -> tuple[str, list[list[float]]]:
        line = json.dumps({"chunks": texts}) + "\n"
        done = subprocess.run(list(command), input=line, capture_output=True, text=True, timeout=timeout, check=True)  # noqa: S603
        got = json.loads(done.stdout.splitlines()[0])
        return got["model"], got["vectors"]

    return embed


def hash_embedder(size: int = 8) -> Embedder:
    """Unit vectors from hashes, for tests. Lanes that the digest has no byte for take one of its digest with the lane."""

    def one(text: str) -> list[float]:
        raw = hashlib.sha256(text.encode()).digest()
        more = lambda i: hashlib.sha256(raw + str(i).encode()).digest()[i % 32]
        v = [(raw[i] if i < len(raw) else more(i)) / 127.5 - 1 for i in range(size)]
        norm = sum(x * x for x in v) ** 0.5 or 1.0
        return [x / norm for x in v]

    return lambda texts: ("hash", [one(t) for t in texts])


def embed(chunks: DataFrame, known: DataFrame, embedder: Embedder, model: str) -> DataFrame:
    """Chunks with embeddings of ``model``: those known by text hash are reused wherever they came
    from, the other texts are embedded once each, in batches of a partition."""
    reuse = known.where((F.col("model") == model) & F.col("embedding").isNotNull())
    reuse = reuse.groupBy("text_hash").agg(F.min_by("embedding", F.struct("version_id", "ix")).alias("embedding"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                name, vectors = embedder(batch["text"].tolist())
                check_vectors(name, vectors, len(batch))
                yield pd.DataFrame({"text_hash": batch["text_hash"], "embedding": vectors})

    missing = chunks.select("text_hash", "text").dropDuplicates(["text_hash"]).join(reuse, "text_hash", "left_anti")
    fresh = missing.mapInPandas(run, "text_hash string, embedding array<float>")
    done = reuse.unionByName(fresh)
    return chunks.join(done, "text_hash").select("version_id", "ix", "text", "text_hash", F.lit(model).alias("model"), "embedding")


def unembedded(live: DataFrame, chunks: DataFrame) -> DataFrame:
    return live.join(chunks.select(F.col("version_id").alias("id")).distinct(), "id", "left_anti")


def upsert_chunks(chunks: DataFrame, fresh: DataFrame) -> DataFrame:
    """``chunks`` with those of the versions in ``fresh`` replaced. Vectors of one version must agree
    in model and size."""
    mixed = fresh.groupBy("version_id").agg(F.count_distinct("model", F.size("embedding")).alias("n")).where("n > 1")
    if mixed.limit(1).count():
        raise EngineError("semantic_unavailable", "a version mixes models or sizes")
    kept = chunks.join(fresh.select("version_id").distinct(), "version_id", "left_anti")
    return kept.unionByName(fresh.select(*[f.split()[0] for f in CHUNK_SCHEMA.split(", ")]))


def model_summary(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("model").agg(F.count(F.lit(1)).alias("n"))


def distances(chunks: DataFrame, vector: Sequence[float], model: str | None = None) -> DataFrame:
    """(version_id, ix, distance) to ``vector`` of every chunk with an embedding of its size."""
    rows = chunks.where(F.col("embedding").isNotNull())
    if model is not None:
        rows = rows.where(F.col("model") == model)
    target = F.array(*[F.lit(float(x)) for x in vector])
    found = columns.cosine_distance(F.col("embedding"), target)
    return rows.select("version_id", "ix", found.alias("distance")).where("distance IS NOT NULL")


def best_chunks(scored: DataFrame) -> DataFrame:
    """(version_id, ix, distance): the nearest chunk of each version, the first of several."""
    best = scored.groupBy("version_id").agg(F.min(F.struct("distance", "ix")).alias("b"))
    return best.select("version_id", "b.ix", "b.distance")


def ranked_chunks(scored: DataFrame) -> DataFrame:
    """The chunks of each version by distance, numbered from 1."""
    order = Window.partitionBy("version_id").orderBy("distance", "ix")
    return scored.withColumn("place", F.row_number().over(order))


def candidates(limit: int) -> int:
    return min(4 * limit, 200)


def nearest(chunks: DataFrame, live: DataFrame, vector: Sequence[float], k: int, model: str | None = None) -> DataFrame:
    """(version_id, distance) of the ``k`` nearest live versions."""
    own = chunks.join(live.select(F.col("id").alias("version_id")), "version_id", "left_semi")
    return best_chunks(distances(own, vector, model)).orderBy("distance", "version_id").limit(k).select("version_id", "distance")

"""The embedding worker: one drain of the backlog, with reuse, changes of model and failed attempts (HS13, VS6, VS7, WR10)."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.operators import history, vectors, writes
from notegraph.operators.cut import written
from notegraph.operators.store import BACKLOG_SCHEMA, CHUNK_SCHEMA

#: Fixed value: characters of an error that are kept.
ERROR = 500

_RESULT = f"{CHUNK_SCHEMA}, error string"


@dataclass(frozen=True)
class Drained:
    """The tables after a drain, and (version_id, outcome) of what was due: processed, failed or skipped."""

    chunks: DataFrame
    backlog: DataFrame
    outcomes: DataFrame


def drain(live_rows: DataFrame, chunks: DataFrame, backlog: DataFrame, embedder: vectors.Embedder, now: str, limit: int | None = None) -> Drained:
    """Embed the versions of the backlog that are due at ``now``, ``limit`` of them if given.

    A version that another follows is skipped: that one has a row of its own. A text that has a vector of the
    model of the version's predecessor keeps it, wherever it comes from; the others go to ``embedder``, a call
    for each version. If it answers with another model, all texts of that version are embedded again. A
    version whose calls fail keeps its chunks, and its row waits longer after each attempt. Versions without
    text have no chunks. Answers are written to a table, so the embedder is called once.
    """
    due = writes.due(backlog, now) if limit is None else writes.dequeue(backlog, now, limit)
    due = due.select("version_id", "attempts")
    heads = live_rows.select(F.col("id").alias("version_id"), "prev_id", "body")
    work = due.join(heads, "version_id")
    cut = vectors.chunked(work.select(F.col("version_id").alias("id"), "body"))
    done = written(_known(cut, _prior(work, chunks), chunks).groupBy("version_id").applyInPandas(_answers(embedder), _RESULT))

    failed = done.where("error IS NOT NULL").select("version_id", "error")
    outcomes = (
        due.join(heads.select("version_id", F.lit("processed").alias("outcome")), "version_id", "left")
        .join(failed, "version_id", "left")
        .select(
            "version_id", F.when(F.col("error").isNotNull(), "failed").otherwise(F.coalesce("outcome", F.lit("skipped"))).alias("outcome"),
        )
    )
    processed = outcomes.where("outcome = 'processed'").select("version_id")
    kept = chunks.join(processed, "version_id", "left_anti")
    fresh = done.where("error IS NULL").select(*_names(CHUNK_SCHEMA))
    waiting = due.join(failed, "version_id").select("version_id", (F.col("attempts") + 1).alias("attempts"), "error")
    retained = waiting.select(
        "version_id", "attempts", F.col("error").alias("last_error"), history.retry_at(now, F.col("attempts")).alias("next_retry_at")
    )
    rest = backlog.join(due.select("version_id"), "version_id", "left_anti").select(*_names(BACKLOG_SCHEMA))
    return Drained(kept.select(*_names(CHUNK_SCHEMA)).unionByName(fresh), rest.unionByName(retained), outcomes)


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _prior(work: DataFrame, chunks: DataFrame) -> DataFrame:
    """(version_id, prior): the model of the first chunk of what each version follows."""
    before = work.where("prev_id IS NOT NULL").select(F.col("prev_id").alias("version_id"), F.col("version_id").alias("_next"))
    return (
        chunks.select("version_id", "ix", "model").join(before, "version_id")
        .groupBy("_next").agg(F.min_by("model", "ix").alias("prior"))
        .withColumnRenamed("_next", "version_id")
    )


def _known(cut: DataFrame, prior: DataFrame, chunks: DataFrame) -> DataFrame:
    """``cut`` with the prior model and, where one is known, the vector of the text under that model."""
    asked = cut.join(prior, "version_id", "left")
    wanted = asked.where("prior IS NOT NULL").select(F.col("prior").alias("model"), "text_hash").distinct()
    found = (
        chunks.where("embedding IS NOT NULL").join(wanted, ["model", "text_hash"], "left_semi")
        .groupBy(F.col("model").alias("prior"), "text_hash")
        .agg(F.min_by("embedding", F.struct("version_id", "ix")).alias("known"))
    )
    return asked.join(found, ["prior", "text_hash"], "left").select("version_id", "ix", "text", "text_hash", "prior", "known")


def _answers(embedder: vectors.Embedder):
    """The chunks of one version with their vectors, or one row with the error. Any fault of a hook is recorded."""

    def ask(texts: list[str]) -> tuple[str, list[list[float]]]:
        model, found = embedder(texts)
        vectors.check_vectors(model, found, len(texts))
        return model, found

    def embed(rows: pd.DataFrame) -> tuple[str, list]:
        texts = rows["text"].tolist()
        found = [None if v is None else list(v) for v in rows["known"]]
        model = rows["prior"].iloc[0]
        missing = [i for i, v in enumerate(found) if v is None]
        if missing:
            prior = model
            model, fresh = ask([texts[i] for i in missing])
            if len(missing) < len(texts) and model != prior:
                model, fresh = ask(texts)
                missing = list(range(len(texts)))
            for i, v in zip(missing, fresh, strict=True):
                found[i] = v
        vectors.check_vectors(model, found, len(texts))
        return model, found

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ix")
        out = rows[["version_id", "ix", "text", "text_hash"]]
        try:
            model, found = embed(rows)
        except Exception as e:  # noqa: BLE001
            return out.head(1).assign(model=None, embedding=None, error=(str(e) or type(e).__name__)[:ERROR])
        return out.assign(model=model, embedding=found, error=None)

    return run

"""Two-way sync as data: verdicts of a reconcile, inbound decisions, and applying a feed (HS8-HS12, JN15)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconcile(local: DataFrame, remote: DataFrame, known: DataFrame) -> DataFrame:
    """(path, verdict) of every path on either side.

    ``local``: (path, version_id, stamped_hash, hash, ignored); ``remote``, the live index: (path,
    version_id, hash); ``known``: (path, version_id) of all versions of the repository. A file is dirty
    if its bytes differ from the hash it was stamped with.
    """
    left = local.select(
        F.col("path").alias("l_path"), F.col("version_id").alias("l_version"), F.col("stamped_hash").alias("l_stamp"),
        F.col("hash").alias("l_hash"), "ignored",
    )
    right = remote.select(F.col("path").alias("r_path"), F.col("version_id").alias("r_version"), F.col("hash").alias("r_hash"))
    elsewhere = remote.select(F.col("version_id").alias("l_version"), F.lit(True).alias("lives")).distinct()
    ours = known.select(F.col("path").alias("l_path"), F.col("version_id").alias("l_version"), F.lit(True).alias("ours")).distinct()
    both = (
        left.join(right, left.l_path == right.r_path, "full_outer")
        .join(elsewhere, "l_version", "left")
        .join(ours, ["l_path", "l_version"], "left")
    )
    dirty = ~F.col("l_stamp").eqNullSafe(F.col("l_hash"))
    at_both = F.col("l_path").isNotNull() & F.col("r_path").isNotNull()
    verdict = (
        F.when(F.coalesce("ignored", F.lit(False)), "ignored")
        .when(F.col("l_path").isNull(), "materialize")
        .when(
            at_both & (F.col("l_hash") == F.col("r_hash")),
            F.when((F.col("l_version") == F.col("r_version")) & (F.col("l_stamp") == F.col("r_hash")), "clean").otherwise("adopt"),
        )
        .when(at_both & F.col("l_version").isNull(), "rebase")
        .when(at_both & (F.col("l_version") == F.col("r_version")), F.when(dirty, "push").otherwise("clean"))
        .when(at_both, F.when(dirty, "rebase").otherwise("materialize"))
        .when(F.col("l_version").isNull() | F.col("lives") | F.col("ours").isNull(), "push")
        .when(dirty, "resurrect")
        .otherwise("delete-local")
    )
    return both.select(F.coalesce("l_path", "r_path").alias("path"), verdict.alias("verdict"))


def inbound(state: DataFrame) -> DataFrame:
    """``state`` (path, ref_version, ref_hash, file_version, file_hash, stamped_hash, hot) with a
    ``decision``: noop, adopt, materialize, rebase or defer."""
    dirty = ~F.col("stamped_hash").eqNullSafe(F.col("file_hash"))
    return state.withColumn(
        "decision",
        F.when(F.col("hot"), "defer")
        .when(F.col("file_hash").isNull(), "materialize")
        .when((F.col("file_hash") == F.col("ref_hash")) & (F.col("file_version") == F.col("ref_version")), "noop")
        .when(F.col("file_hash") == F.col("ref_hash"), "adopt")
        .when(dirty, "rebase")
        .otherwise("materialize"),
    )


def bursts(changes: DataFrame, gap: str = "2 seconds") -> DataFrame:
    """(path, started, ended, n, present): changes to a path coalesced until it has been quiet for
    ``gap``; a file that was there at any moment counts as present. ``changes``: (path, at, present)."""
    return changes.groupBy("path", F.session_window("at", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.max("present").alias("present")
    ).select("path", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n", "present")


def pushes(burst: DataFrame, local: DataFrame, known: DataFrame) -> DataFrame:
    """(path, action, version_id, turn): what a burst of changed paths pushes, what is present before what is not.

    ``burst``: (path), repeats allowed; ``local``: (path, version_id), the files there are, by the version in
    them; ``known``: (path, version_id), the last known remote state. A present path is put. Of the absent ones,
    a path never tracked is left alone (untracked), one whose version another present file of the burst carries
    was renamed (moved), and the others are deleted, as ``version_id`` of ``known``.
    """
    mine = local.groupBy("path").agg(F.max("version_id").alias("local_version"))
    last = known.groupBy("path").agg(F.max("version_id").alias("known_version"))
    paths = burst.select("path").distinct().join(mine.withColumn("present", F.lit(True)), "path", "left").join(last, "path", "left")
    carried = paths.where("present AND local_version IS NOT NULL").select(F.col("local_version").alias("known_version")).distinct()
    joined = paths.join(carried.withColumn("carried", F.lit(True)), "known_version", "left")
    action = (
        F.when(F.col("present"), "put")
        .when(F.col("known_version").isNull(), "untracked")
        .when(F.col("carried"), "moved")
        .otherwise("delete")
    )
    version = F.when(F.col("present"), F.col("local_version")).otherwise(F.col("known_version"))
    return joined.select("path", action.alias("action"), version.alias("version_id"), F.when(F.col("present"), 0).otherwise(1).alias("turn"))


def net_effect(refs: DataFrame) -> DataFrame:
    """(document_id, path, prev_path, op, id): what applying the references in order comes to, by
    document: the first path before, and the last version."""
    return (
        refs.groupBy("document_id")
        .agg(
            F.min_by("prev_path", "id").alias("prev_path"),
            F.max_by(F.struct("path", "op"), "id").alias("last"),
            F.max("id").alias("id"),
        )
        .select("document_id", "last.path", "prev_path", "last.op", "id")
    )

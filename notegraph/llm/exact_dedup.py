"""Exact dedup by content sort.

Rows are dealt by sampled splitters over the start of the case-folded text and a hash of the whole of
it, each partition is sorted by the whole normalised text (spilling as needed), and neighbours are
compared in full: the window below starts a new group wherever two neighbouring texts differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notegraph.llm.common import ascii_lower, durable, every

#: A text held by more than this share of the rows is sorted in SALTS parts, so at most 1 / HOT_SHARE
#: texts are; that bounds the list sent to the executors.
HOT_SHARE = 1 / 256
SALTS = 64
SENT = 100_000


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    columns: tuple[Column, ...] = (),
) -> DataFrame:
    """One row for each row of ``docs``: (doc_id, keep_id, group_size, kept, text_sha256), and with
    ``columns`` those of its row too, as the struct ``row``, and ``place``, which is 1 for one of the kept rows of a group.

    Texts are equal when identical after lower-casing A-Z. ``keep`` names the identifier that stays in
    a group: "smallest" or "largest". A null text counts as empty. Null identifiers never stay while
    the group has another; a group of null identifiers only has a null ``keep_id``. Of rows repeated
    with the same identifier that stays, each has ``kept`` true. Other columns are ignored, whatever
    their names; an empty table gives an empty result.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep: {keep!r}")
    stays = F.min if keep == "smallest" else F.max
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.struct(*(columns or (F.col(text_col),))).alias("row")
    )
    raw = F.coalesce(F.col("row")[text_col], F.lit(""))
    folded = F.lower(raw)
    rows = rows.withColumns({"start": F.substring(folded, 1, 32), "mark": F.xxhash64(folded)})
    total = docs.count()
    hot = [
        r[0]
        for r in rows.groupBy("mark")
        .count()
        .where(F.col("count") > max(2, total * HOT_SHARE))
        .select("mark")
        .collect()
    ]
    is_hot = F.col("mark").isin(hot) if hot else F.lit(False)
    salt = F.when(is_hot, F.pmod(F.xxhash64("doc_id", "mark"), F.lit(SALTS))).otherwise(F.lit(0))
    # A constant salt would be folded away, and the window could not use the range partitioning.
    order = ["start", "mark", "salt"] if hot else ["start", "mark"]
    dealt = rows.withColumn("salt", salt.cast("int")).repartitionByRange(*order)
    best = F.asc_nulls_last("doc_id") if keep == "smallest" else F.desc_nulls_last("doc_id")
    ranked = Window.partitionBy(*order, "norm").orderBy(best)
    same = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    part = dealt.withColumn("norm", ascii_lower(raw)).select(
        "doc_id",
        *(["row", F.row_number().over(ranked).alias("place")] if columns else []),
        F.sha2("norm", 256).alias("text_sha256"),
        stays("doc_id").over(same).alias("keep_id"),
        F.count(F.lit(1)).over(same).alias("group_size"),
    )
    if hot:
        # The parts of a text that was split meet here. Texts with one mark can still differ in the
        # case of letters other than A-Z, so the number of rows is checked before they are sent out.
        whole = durable(
            rows.where(is_hot)
            .select("doc_id", F.sha2(ascii_lower(raw), 256).alias("text_sha256"))
            .groupBy("text_sha256")
            .agg(stays("doc_id").alias("hot_keep"), F.count(F.lit(1)).alias("hot_size"))
        )
        part = part.join(F.broadcast(whole) if whole.count() <= SENT else whole, "text_sha256", "left").withColumns(
            {
                "keep_id": F.when(F.col("hot_size").isNull(), F.col("keep_id")).otherwise(F.col("hot_keep")),
                "group_size": F.coalesce("hot_size", "group_size"),
            }
        )
    return part.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
        *(["row", "place"] if columns else []),
    )


def unique(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` whose text's kept identifier is their own; a row repeated whole stays once,
    and so does one text among rows without identifier."""
    # Rows with one identifier are in the same part of a text that was split, so one has place 1.
    return exact_dedup(docs, keep=keep, columns=tuple(every(docs))).where("kept AND place = 1").select("row.*")


SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM n WINDOW g AS (PARTITION BY norm)
"""

"""The reference tables seen as collections of documents, versions and links.

Each view is written twice, as a DataFrame and as the SQL that the checks start from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notegraph.operators.cut import written
from notegraph.operators.store import Store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live documents with front matter whose keys are missing, scalar, lists or null by doc_id."""
    x = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    text = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    part = lambda name, value: F.concat(F.lit(f',"{name}":'), value)
    tags = (
        F.when(F.col("doc_id") % 4 == 1, part("tags", text("lang")))
        .when(F.col("doc_id") % 4 == 2, part("tags", F.concat(F.lit("["), text("lang"), F.lit(","), text("source"), F.lit("]"))))
        .when(F.col("doc_id") % 4 == 3, F.lit(',"tags":null'))
        .otherwise("")
    )
    flag = (
        F.when(F.col("doc_id") % 5 == 0, F.lit(',"flag":true'))
        .when(F.col("doc_id") % 5 == 1, F.lit(',"flag":"yes"'))
        .when(F.col("doc_id") % 5 == 2, F.lit(',"flag":1'))
        .otherwise("")
    )
    json = F.concat(
        F.lit('{"lang":'), text("lang"), part("source", text("source")), part("n_chars", F.col("n_chars").cast("string")),
        F.coalesce(part("quality", F.col("quality").cast("string")), F.lit("")), tags, flag,
        F.lit(',"meta":{"owner":'), text("source"), part("rank", (F.col("doc_id") % 7).cast("string")), F.lit("}}"),
    )
    folder = F.when(F.col("doc_id") % 29 == 0, ".drafts/").when(F.col("doc_id") % 31 == 0, ":deleted/").otherwise("")
    path = F.concat(folder, F.col("lang"), F.lit("/"), F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(".md"))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    at = F.concat(F.lit("2024-"), two(F.col("doc_id") % 12 + 1), F.lit("-"), two(F.col("doc_id") % 28 + 1), F.lit("T00:00:00.000Z"))
    raw = F.concat(F.lit("lang: "), F.col("lang"), F.lit("\n"))
    return x.select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("document_id"), (F.col("doc_id") % 3).alias("repo_id"),
        F.lit(None).cast("long").alias("prev_id"), path.alias("path"), F.lower(path).alias("path_norm"),
        raw.alias("frontmatter_raw"), F.parse_json(json).alias("frontmatter"), F.col("text").alias("body"),
        F.col("source").alias("author"), at.alias("created_at"), F.lit(None).cast("string").alias("content_hash"),
    )


D = """d AS (
  SELECT x.doc_id AS id, x.doc_id % 3 AS repo_id,
         CASE WHEN x.doc_id % 29 = 0 THEN '.drafts/' WHEN x.doc_id % 31 = 0 THEN ':deleted/' ELSE '' END
           || lang || '/' || source || '/' || x.doc_id || '.md' AS path,
         text AS body, lang, source, n_chars, quality,
         '2024-' || lpad(CAST(x.doc_id % 12 + 1 AS VARCHAR), 2, '0') || '-'
           || lpad(CAST(x.doc_id % 28 + 1 AS VARCHAR), 2, '0') || 'T00:00:00.000Z' AS created_at
  FROM documents x LEFT JOIN labels l ON x.doc_id = l.doc_id
)"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a version log: a document for each user, each event a version of it."""
    e = table(spark, sf_dir, "events")
    id_ = F.col("event_id") + 1
    path = F.when(
        F.col("event_type") == "error", F.concat(F.lit(":deleted/u"), "user_id", F.lit("-v"), id_, F.lit(".md"))
    ).otherwise(F.concat("event_type", F.lit("/u"), "user_id", F.lit(".md")))
    return e.select(
        id_.alias("id"), F.col("user_id").alias("document_id"), (F.col("user_id") % 3).alias("repo_id"),
        (F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id")) + 1).alias("prev_id"),
        path.alias("path"), path.alias("path_norm"), F.lit("").alias("frontmatter_raw"), F.parse_json("props").alias("frontmatter"),
        F.col("event_type").alias("body"), F.lit("log").alias("author"), F.date_format("ts", ISO).alias("created_at"),
        F.sha2("event_type", 256).alias("content_hash"),
    )


V = """v AS (
  SELECT event_id + 1 AS id, user_id AS document_id, user_id % 3 AS repo_id,
         lag(event_id + 1) OVER (PARTITION BY user_id ORDER BY event_id) AS prev_id,
         CASE WHEN event_type = 'error' THEN ':deleted/u' || user_id || '-v' || (event_id + 1) || '.md'
              ELSE event_type || '/u' || user_id || '.md' END AS path,
         event_type AS body, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS created_at, ts
  FROM events
)"""

KIND = 10_000_000_000
KINDS = {"region": 1, "nation": 2, "customer": 3, "supplier": 4, "part": 5, "order": 6}
_NODES = {
    "region": ("region", "r_regionkey", "r_name", "r_regionkey"),
    "nation": ("nation", "n_nationkey", "n_name", "n_regionkey"),
    "customer": ("customer", "c_custkey", "c_name", "c_acctbal"),
    "supplier": ("supplier", "s_suppkey", "s_name", "s_acctbal"),
    "part": ("part", "p_partkey", "p_name", "p_size"),
    "order": ("orders", "o_orderkey", "o_orderpriority", "o_totalprice"),
}


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each row of the sales tables; parts of size 1 are missing."""
    out = None
    for kind, (name, key, title, num) in _NODES.items():
        rows = table(spark, sf_dir, name)
        if kind == "part":
            rows = rows.where("p_size <> 1")
        id_ = (F.col(key).cast("long") + KINDS[kind] * KIND).alias("id")
        path = F.concat(F.lit(kind + "/"), F.col(key), F.lit(".md"))
        json = F.to_json(F.struct(F.lit(kind).alias("kind"), F.col(title).alias("title"), F.col(num).cast("double").alias("num")))
        part = rows.select(
            id_, id_.alias("document_id"), F.lit(0).cast("long").alias("repo_id"), path.alias("path"),
            path.alias("path_norm"), F.parse_json(json).alias("frontmatter"), F.lit("").alias("body"),
            F.lit("2024-01-01T00:00:00.000Z").alias("created_at"), F.lit(None).cast("string").alias("content_hash"),
        )
        out = part if out is None else out.unionByName(part)
    assert out is not None
    return out


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys as links; those to missing parts are unresolved."""
    t = lambda n: table(spark, sf_dir, n)
    node = lambda kind, c: F.col(c).cast("long") + KINDS[kind] * KIND
    path = lambda kind, c: F.concat(F.lit(kind + "/"), F.col(c), F.lit(".md"))

    def edge(rows: DataFrame, source, kind: str, key: str, ord_=None, bound=None) -> DataFrame:
        target = node(kind, key)
        return rows.select(
            F.lit(0).cast("long").alias("repo_id"), source.alias("source_id"),
            (F.lit(0) if ord_ is None else ord_).cast("int").alias("ord"), F.lit(kind).alias("field"),
            path(kind, key).alias("target_raw"), path(kind, key).alias("target_norm"),
            (target if bound is None else F.when(bound, target)).alias("target_id"),
        )

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = t("lineitem").withColumn("n", F.row_number().over(w))
    small = t("part").where("p_size = 1").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("gone"))
    lines = lines.join(small, "l_partkey", "left")
    parts = [
        edge(t("nation"), node("nation", "n_nationkey"), "region", "n_regionkey"),
        edge(t("customer"), node("customer", "c_custkey"), "nation", "c_nationkey"),
        edge(t("supplier"), node("supplier", "s_suppkey"), "nation", "s_nationkey"),
        edge(t("orders"), node("order", "o_orderkey"), "customer", "o_custkey"),
        edge(lines, node("order", "l_orderkey"), "part", "l_partkey", F.col("n") * 2 - 1, F.col("gone").isNull()),
        edge(lines, node("order", "l_orderkey"), "supplier", "l_suppkey", F.col("n") * 2),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


G = f"""n AS (
  SELECT {KIND} * 1 + r_regionkey AS id, 'region/' || r_regionkey || '.md' AS path, 'region' AS kind, r_name AS title, CAST(r_regionkey AS DOUBLE) AS num FROM region
  UNION ALL SELECT {KIND} * 2 + n_nationkey, 'nation/' || n_nationkey || '.md', 'nation', n_name, CAST(n_regionkey AS DOUBLE) FROM nation
  UNION ALL SELECT {KIND} * 3 + c_custkey, 'customer/' || c_custkey || '.md', 'customer', c_name, c_acctbal FROM customer
  UNION ALL SELECT {KIND} * 4 + s_suppkey, 'supplier/' || s_suppkey || '.md', 'supplier', s_name, s_acctbal FROM supplier
  UNION ALL SELECT {KIND} * 5 + p_partkey, 'part/' || p_partkey || '.md', 'part', p_name, CAST(p_size AS DOUBLE) FROM part WHERE p_size <> 1
  UNION ALL SELECT {KIND} * 6 + o_orderkey, 'order/' || o_orderkey || '.md', 'order', o_orderpriority, o_totalprice FROM orders
), li AS (
  SELECT l_orderkey, l_partkey, l_suppkey,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k
  FROM lineitem
), lk AS (
  SELECT {KIND} * 2 + n_nationkey AS source_id, 0 AS ord, 'region' AS field, 'region/' || n_regionkey || '.md' AS target_norm, {KIND} * 1 + n_regionkey AS target_id FROM nation
  UNION ALL SELECT {KIND} * 3 + c_custkey, 0, 'nation', 'nation/' || c_nationkey || '.md', {KIND} * 2 + c_nationkey FROM customer
  UNION ALL SELECT {KIND} * 4 + s_suppkey, 0, 'nation', 'nation/' || s_nationkey || '.md', {KIND} * 2 + s_nationkey FROM supplier
  UNION ALL SELECT {KIND} * 6 + o_orderkey, 0, 'customer', 'customer/' || o_custkey || '.md', {KIND} * 3 + o_custkey FROM orders
  UNION ALL SELECT {KIND} * 6 + l_orderkey, 2 * k - 1, 'part', 'part/' || l_partkey || '.md',
                   CASE WHEN p_size <> 1 THEN {KIND} * 5 + l_partkey END FROM li JOIN part ON p_partkey = l_partkey
  UNION ALL SELECT {KIND} * 6 + l_orderkey, 2 * k, 'supplier', 'supplier/' || l_suppkey || '.md', {KIND} * 4 + l_suppkey FROM li
)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as chunks, four to a version; the model goes by the version."""
    v = F.floor(F.col("vec_id") / 4)
    return table(spark, sf_dir, "embeddings").select(
        v.alias("version_id"), (F.col("vec_id") % 4).cast("int").alias("ix"), F.concat(F.lit("t"), F.col("vec_id") % 100).alias("text"),
        F.sha2(F.concat(F.lit("t"), F.col("vec_id") % 100), 256).alias("text_hash"), F.concat(F.lit("m"), v % 2).alias("model"), "embedding",
    )


C = """c AS (
  SELECT vec_id // 4 AS version_id, vec_id % 4 AS ix, 'm' || ((vec_id // 4) % 2) AS model,
         CAST(embedding AS DOUBLE[]) AS e, vec_id FROM embeddings
)"""


_stored: dict[tuple[str, str], Store] = {}


def graph_store(spark: SparkSession, sf_dir: str, stored: bool = False) -> Store:
    """Documents and links. ``stored``: as tables that are written once in a session, as a store has
    them; walks of several rounds read these."""
    key = (spark._jsparkSession.sessionUUID(), sf_dir)
    if stored and key in _stored:
        return _stored[key]
    own = nodes(spark, sf_dir).withColumn("prev_id", F.lit(None).cast("long"))
    edges = links(spark, sf_dir)
    if not stored:
        return Store(versions=own, links=edges)
    _stored[key] = Store(versions=written(own), links=written(edges))
    return _stored[key]

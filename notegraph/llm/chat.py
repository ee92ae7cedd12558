"""Chat formatting by quotation linking, with DataFrame functions alone.

Quoted lines are read with their nesting levels. A run of lines of one level is a passage; its
normalised text, its paragraphs and its lines are hashed and joined to the hashes of the unquoted
text, paragraphs and lines of all messages. A message answers the message it quotes; conversations
are laid out so that an answer follows what it answers, and quotes are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notegraph.llm.common import durable

_MARK = r"^[ \t]*((?:>[ \t]?)+)"
#: A line that announces a quote, right before it. Fixed values.
_LEAD = r"^(On|Am|Le|El)\b.*(wrote|schrieb|écrit|escribió).*:[ \t]*$"


def normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")))


def _units(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep..., rank, unit): hashes of the whole text, its paragraphs and its lines, without empty ones."""
    tagged = lambda parts, rank: F.transform(parts, lambda x: F.struct(F.lit(rank).alias("rank"), normal(x).alias("t")))
    all_ = F.concat(
        tagged(F.array(F.col(text)), 0),
        tagged(F.split(text, r"\n[ \t]*\n"), 1),
        tagged(F.split(text, r"\n"), 2),
    )
    return (
        rows.select(*keep, F.explode(all_).alias("u"))
        .where("u.t <> ''")
        .select(*keep, "u.rank", F.xxhash64("u.t").alias("unit"))
    )


def parse(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages with their unquoted text ``own`` and number of passages ``n_quotes``; passages with
    their level, place and text). Only messages with a quoted line are taken apart."""
    rows = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    key = ["conv_id", "turn", "mark"]
    rows = rows.withColumn("mark", F.xxhash64("role", "text"))
    quoting = F.col("text").rlike(r"(?m)" + _MARK)
    plain = rows.where(~quoting).select(*key, "role", F.trim("text").alias("own"), F.lit(0).alias("n_quotes"))
    lines = (
        rows.where(quoting)
        .dropDuplicates(key)
        .select(*key, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .withColumn("sign", F.regexp_extract("line", _MARK, 1))
        .withColumn("level", F.length(F.regexp_replace("sign", "[^>]", "")))
        .withColumn("body", F.when(F.col("level") > 0, F.regexp_replace("line", _MARK, "")).otherwise(F.col("line")))
    )
    in_order = Window.partitionBy(*key).orderBy("pos")
    lines = lines.withColumn("change", (F.col("level") != F.lag("level", 1, -1).over(in_order)).cast("int"))
    lines = lines.withColumn("next", F.lead("level", 1, 0).over(in_order))
    lines = lines.withColumn("run", F.sum("change").over(in_order))
    lines = lines.where(~((F.col("level") == 0) & (F.col("next") > 0) & F.col("line").rlike(_LEAD)))

    def text_of(group: DataFrame, name: str) -> DataFrame:
        sorted_ = F.array_sort(F.collect_list(F.struct("pos", "body")))
        return group.agg(F.array_join(F.transform(sorted_, lambda x: x["body"]), "\n").alias(name))

    passages = text_of(lines.where("level > 0").groupBy(*key, "run", "level"), "passage")
    own = text_of(lines.where("level = 0").groupBy(*key), "own")
    counts = passages.groupBy(*key).agg(F.count(F.lit(1)).cast("int").alias("n_quotes"))
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in key]
    taken = (
        rows.where(quoting).alias("r")
        .join(own.alias("o"), same("r", "o"), "left")
        .join(counts.alias("c"), same("r", "c"), "left")
        .select("r.conv_id", "r.turn", "r.mark", "r.role", F.trim(F.coalesce("own", F.lit(""))).alias("own"), F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"))
    )
    return plain.unionByName(taken), passages


def links(messages: DataFrame, passages: DataFrame) -> DataFrame:
    """(conv_id, turn, mark, parent): the message that each quoting message answers. It is the first of
    the same conversation that holds the quoted text, or else the first of all, and comes before the
    quoting one. The outermost level counts first, then a whole passage before its paragraphs and
    lines, then the order of the text. Firsts are combined before the shuffle, so a text that very many
    messages hold costs no more than another."""
    originals = _units(messages.where("conv_id IS NOT NULL AND turn IS NOT NULL"), "own", "conv_id", "turn")
    quoted = _units(passages, "passage", "conv_id", "turn", "mark", "level", "run")
    wanted = quoted.select("unit").distinct()
    originals = originals.join(wanted, "unit", "left_semi")
    # Written, so that the joins have two plain exchanges each and a text that very many quote can be split.
    here = durable(originals.groupBy("unit", "conv_id").agg(F.min("turn").alias("here")))
    anywhere = durable(here.groupBy("unit").agg(F.min(F.struct("conv_id", F.col("here").alias("turn"))).alias("anywhere")))
    found = (
        quoted.join(here, ["unit", "conv_id"], "left")
        .join(anywhere, "unit")
        .withColumn(
            "parent",
            F.when(F.col("here") < F.col("turn"), F.struct("conv_id", F.col("here").alias("turn"))).when(
                F.col("anywhere") < F.struct("conv_id", "turn"), F.col("anywhere")
            ),
        )
        .where("parent IS NOT NULL")
    )
    best = found.groupBy("conv_id", "turn", "mark").agg(F.min(F.struct("level", "rank", "run", "parent")).alias("b"))
    return best.select("conv_id", "turn", "mark", F.col("b.parent").alias("parent"))


def paths(found: DataFrame) -> DataFrame:
    """(conv_id, turn, mark, parent, path): the messages from the root to the parent of each quoting
    message. Every round joins the paths to those of their tops, so the longest doubles."""
    at = durable(found.withColumn("path", F.array("parent")))
    # Messages with one conv_id and turn are one place; the first of them by mark leads on.
    while True:
        lead = at.groupBy(F.struct("conv_id", "turn").alias("top")).agg(F.min(F.struct("mark", "path")).alias("m"))
        grown = (
            at.withColumn("top", F.get("path", F.lit(0)))
            .join(lead, "top", "left")
            .withColumn("grew", F.col("m").isNotNull())
            .withColumn("path", F.when(F.col("m").isNull(), F.col("path")).otherwise(F.concat(F.col("m.path"), F.col("path"))))
            .drop("top", "m")
        )
        grown = durable(grown)
        if not grown.where("grew").limit(1).count():
            return grown.drop("grew")
        at = durable(grown.drop("grew"))


def conversations(messages: DataFrame) -> DataFrame:
    """(thread, position, conv_id, turn, role, text, reply_conv, reply_turn, depth, n_quotes): a row
    for each message, with its text without quotes.

    ``thread`` is the conversation of the message at the root of the replies; positions count from 0
    within it: roots by turn, and after each message the replies to it, in the same order. A message
    quoting nothing known is a root of its own conversation. Null texts count as empty; messages
    without conversation or turn are kept, answer nobody's and are answered by none; they sort first.
    Rows repeated whole are each a row. Other columns are ignored; an empty table gives none.
    """
    parsed, passages = parse(messages)
    parsed = durable(parsed)
    passages = durable(passages)
    replies = paths(links(parsed, passages))
    key = ["conv_id", "turn", "mark"]
    p = parsed.alias("p")
    r = replies.alias("r")
    both = p.join(r, [F.col(f"p.{k}") == F.col(f"r.{k}") for k in key], "left").select(
        "p.*", "r.parent", F.coalesce("r.path", F.array().cast("array<struct<conv_id:bigint,turn:bigint>>")).alias("path")
    )
    place = F.struct("conv_id", "turn")
    laid = both.select(
        F.when(F.size("path") > 0, F.get("path", F.lit(0))["conv_id"]).otherwise(F.col("conv_id")).alias("thread"),
        F.concat("path", F.array(place)).alias("path"),
        "conv_id", "turn", "mark", "role", "own", "n_quotes", "parent",
    )
    order = ["thread", "path", "mark"]
    # The rank in the whole order is the rank in a partition of it and the rows of those before.
    sorted_ = durable(
        laid.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("n", F.monotonically_increasing_id())
    )
    part = F.shiftright("n", 33)
    sizes = sorted_.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    before = sizes.select(
        "part", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    # One row for each partition of the shuffle.
    ranked = sorted_.withColumn("part", part).join(F.broadcast(before), "part").withColumn(
        "rank", F.col("before") + F.col("n").bitwiseAND(F.lit((1 << 33) - 1))
    )
    starts = ranked.groupBy("thread").agg(F.min("rank").alias("start")).withColumnRenamed("thread", "t")
    return ranked.join(starts, F.col("thread").eqNullSafe(F.col("t"))).select(
        "thread",
        (F.col("rank") - F.col("start")).alias("position"),
        "conv_id",
        "turn",
        "role",
        F.col("own").alias("text"),
        F.col("parent.conv_id").alias("reply_conv"),
        F.col("parent.turn").alias("reply_turn"),
        (F.size("path") - 1).alias("depth"),
        "n_quotes",
    )


#: The same over a table whose (conv_id, turn) are unique and not null.
SQL = r"""
WITH RECURSIVE m AS (
  SELECT row_number() OVER () AS r, conv_id, turn, role, coalesce(text, '') AS text FROM conversations
), l AS (
  SELECT r, conv_id, turn, unnest(string_split(text, chr(10))) AS line,
         unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos FROM m
), p AS (
  SELECT *, length(regexp_replace(regexp_extract(line, '^[ \t]*((?:>[ \t]?)+)', 1), '[^>]', '', 'g')) AS level FROM l
), q AS (
  SELECT *, CASE WHEN level > 0 THEN regexp_replace(line, '^[ \t]*((?:>[ \t]?)+)', '') ELSE line END AS body,
         lead(level, 1, 0) OVER (PARTITION BY r ORDER BY pos) AS after, lag(level, 1, -1) OVER (PARTITION BY r ORDER BY pos) AS prior FROM p
), k AS (
  SELECT *, sum(CASE WHEN level <> prior THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY pos) AS run FROM q
), kept AS (
  SELECT * FROM k WHERE NOT (level = 0 AND after > 0 AND regexp_matches(line, '^(On|Am|Le|El)\b.*(wrote|schrieb|écrit|escribió).*:[ \t]*$'))
), o AS (
  SELECT m.r, m.conv_id, m.turn, m.role, trim(coalesce(string_agg(body, chr(10) ORDER BY pos), '')) AS own
  FROM m LEFT JOIN kept ON kept.r = m.r AND level = 0 GROUP BY ALL
), g AS (
  SELECT r, conv_id, turn, run, level, string_agg(body, chr(10) ORDER BY pos) AS passage FROM kept WHERE level > 0 GROUP BY ALL
), ou AS (
  SELECT conv_id, turn, unnest(list_concat([own], string_split(own, chr(10)), regexp_split_to_array(own, '\n[ \t]*\n'))) AS u FROM o
), original AS (
  SELECT conv_id, turn, lower(trim(regexp_replace(u, '[ \t-\r]+', ' ', 'g'))) AS unit FROM ou
), gu AS (
  SELECT r, conv_id, turn, run, level, 0 AS rank, passage AS u FROM g
  UNION ALL SELECT r, conv_id, turn, run, level, 1, unnest(regexp_split_to_array(passage, '\n[ \t]*\n')) FROM g
  UNION ALL SELECT r, conv_id, turn, run, level, 2, unnest(string_split(passage, chr(10))) FROM g
), quoted AS (
  SELECT *, lower(trim(regexp_replace(u, '[ \t-\r]+', ' ', 'g'))) AS unit FROM gu
), here AS (SELECT unit, conv_id, min(turn) AS t FROM original GROUP BY ALL
), anywhere AS (
  SELECT unit, conv_id AS c, turn AS t FROM original QUALIFY row_number() OVER (PARTITION BY unit ORDER BY conv_id, turn) = 1
), found AS (
  SELECT q.r, q.level, q.rank, q.run,
         CASE WHEN h.t < q.turn THEN q.conv_id WHEN (a.c, a.t) < (q.conv_id, q.turn) THEN a.c END AS pc,
         CASE WHEN h.t < q.turn THEN h.t WHEN (a.c, a.t) < (q.conv_id, q.turn) THEN a.t END AS pt
  FROM quoted q JOIN anywhere a ON a.unit = q.unit LEFT JOIN here h ON h.unit = q.unit AND h.conv_id = q.conv_id
  WHERE q.unit <> ''
), rep AS (
  SELECT r, pc, pt FROM found WHERE pc IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY level, rank, run, pc, pt) = 1
), w AS (
  SELECT r, pc, pt, [{'c': pc, 't': pt}] AS path FROM rep
  UNION ALL
  SELECT w.r, n.pc, n.pt, list_concat([{'c': n.pc, 't': n.pt}], w.path)
  FROM w JOIN m ON m.conv_id = w.pc AND m.turn = w.pt JOIN rep n ON n.r = m.r
), best AS (
  SELECT r, path FROM w QUALIFY row_number() OVER (PARTITION BY r ORDER BY len(path) DESC) = 1
), laid AS (
  SELECT o.*, coalesce(best.path[1].c, o.conv_id) AS thread, coalesce(len(best.path), 0) AS depth,
         list_concat(coalesce(best.path, []), [{'c': o.conv_id, 't': o.turn}]) AS path
  FROM o LEFT JOIN best ON best.r = o.r
), n AS (SELECT r, count(*) AS n FROM g GROUP BY r)
SELECT thread, row_number() OVER (PARTITION BY thread ORDER BY path) - 1 AS position, conv_id, turn, role, own AS text,
       pc AS reply_conv, pt AS reply_turn, CAST(depth AS INTEGER) AS depth, CAST(coalesce(n.n, 0) AS INTEGER) AS n_quotes
FROM laid LEFT JOIN rep ON rep.r = laid.r LEFT JOIN n ON n.r = laid.r
"""

"""Chains of versions, listings, and the change feed with its safe frontier (HS1-HS7, HS13, HS16)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notegraph.functions import columns
from notegraph.operators.cut import written
from notegraph.operators.store import live
from notegraph.plans.visibility import Visibility, matches_any

# The bounds of the feed.
WINDOW_MS, FEED_PAGE, INDEX_PAGE, LIST_PAGE, TAIL, SCAN = 30_000, 500, 1000, 100, 1000, 10_000


def chain(versions: DataFrame, head: int, limit: int = LIST_PAGE, before: int | None = None) -> DataFrame:
    """The versions from ``head`` (or from before ``before``) back along ``prev_id``, newest first by
    place in the chain, with that place as ``depth``; ``limit`` of them at most. A predecessor has a
    smaller id, so the walk reads pages of the document's pointers by descending id."""
    first = versions.where(F.col("id") == (head if before is None else before)).select("document_id", "id", "prev_id").limit(1).collect()
    spark = versions.sparkSession
    at = None if not first else first[0].id if before is None else first[0].prev_id
    found: list[int] = []
    size = 4 * limit + 1
    while at is not None and len(found) < limit:
        own = versions.where((F.col("document_id") == first[0].document_id) & (F.col("id") <= at))
        page = {r.id: r.prev_id for r in own.select("id", "prev_id").orderBy(F.desc("id")).limit(size).collect()}
        if at not in page:
            break
        while at in page and len(found) < limit:
            found.append(at)
            at = page[at]
    places = spark.createDataFrame([(v, i) for i, v in enumerate(found)], "id long, depth int")
    return versions.where(F.col("id").isin(found) if found else F.lit(False)).join(F.broadcast(places), "id").orderBy("depth")


def depths(versions: DataFrame) -> DataFrame:
    """(id, root, depth) of every version of every chain, by pointer doubling: rounds grow with the
    logarithm of the longest chain."""
    at = versions.select("id", F.col("prev_id").alias("up"), F.col("prev_id").isNotNull().cast("long").alias("depth"))
    at = written(at)
    while at.where("up IS NOT NULL").limit(1).count():
        above = at.select(F.col("id").alias("a"), F.col("up").alias("a_up"), F.col("depth").alias("a_depth"))
        joined = at.join(above, at.up == above.a, "left")
        grown = joined.select(
            "id",
            F.col("a_up").alias("up"),
            (F.col("depth") + F.coalesce("a_depth", F.lit(0))).alias("depth"),
        )
        at = written(grown)
    return at.select("id", "depth")


def refs(versions: DataFrame, system: str = ":", log: DataFrame | None = None) -> DataFrame:
    """Version references with the path before and the operation. ``log``: where predecessors are, if not in
    ``versions``."""
    before = (versions if log is None else log).select(F.col("id").alias("prev_id"), F.col("path").alias("prev_path"))
    joined = versions.join(before, "prev_id", "left")
    return joined.withColumn("op", columns.operation(F.col("path"), F.col("prev_path"), system))


def listing(
    versions: DataFrame,
    globs: tuple[str, ...] = ("**",),
    ever: bool = False,
    since: int | None = None,
    until: int | None = None,
    visibility: Visibility = Visibility(),
    descending: bool = True,
    limit: int = LIST_PAGE,
) -> DataFrame:
    """Whole chains, interleaved by id, of the documents whose live path (or with ``ever`` any path)
    matches; since < id <= until. Scope comes before the limit."""
    rows = versions if ever else live(versions)
    documents = rows.where(matches_any(F.col("path"), globs)).select("document_id").distinct()
    found = refs(versions).join(documents, "document_id", "left_semi").where(visibility.visible())
    if since is not None:
        found = found.where(F.col("id") > since)
    if until is not None:
        found = found.where(F.col("id") <= until)
    return found.orderBy(F.desc("id") if descending else F.asc("id")).limit(limit)


def safe_upper(rows: DataFrame, after: int, now_ms: int, window_ms: int = WINDOW_MS, scan: int | None = SCAN) -> int:
    """The last id before the first hot gap after ``after``: a gap whose successor is younger than the
    window may still be filled. ``rows``: (id, created_at). A page of a feed looks at ``scan`` rows at
    most, whatever the size of the log; without ``scan`` the frontier is that of the whole log. A gap's
    successor is a row whose id follows no other, so no ordered window over the rows is needed."""
    page = rows.where(F.col("id") > after).select("id", F.unix_millis(F.to_timestamp("created_at")).alias("ms"))
    if scan is not None:
        page = page.orderBy("id").limit(scan)
    young = page.where((F.col("id") > after + 1) & (F.lit(now_ms) - F.col("ms") < window_ms)).select("id", (F.col("id") - 1).alias("before"))
    stop = young.join(page.select(F.col("id").alias("before")), "before", "left_anti").agg(F.min("id").alias("i")).first().i
    top = (page if stop is None else page.where(F.col("id") < stop)).agg(F.max("id").alias("m")).first().m
    return after if top is None else int(top)


def feed(
    versions: DataFrame,
    after: int,
    now_ms: int,
    repo_id: int | None = None,
    limit: int = FEED_PAGE,
    window_ms: int = WINDOW_MS,
    visibility: Visibility = Visibility(),
    frontier: int | None = None,
) -> tuple[DataFrame, int]:
    """(settled references after the cursor, the next cursor). ``frontier``: that of the log, if the
    caller knows it; else it is looked for in the rows that one poll scans. A page ends at the ``limit``-th match if
    another follows in the safe region, else at the frontier. A reference shows if either of its ends
    is in scope. A page has ``limit`` rows at most, so the log is searched for what they follow by a
    broadcast of their ids and isn't shuffled."""
    upper = safe_upper(versions, after, now_ms, window_ms) if frontier is None else frontier
    rows = versions.where((F.col("id") > after) & (F.col("id") <= upper))
    mine = rows if repo_id is None else rows.where(F.col("repo_id") == repo_id)
    ids = [r.id for r in mine.select("id").orderBy("id").limit(limit + 1).collect()]
    if len(ids) > limit:
        upper = ids[limit - 1]
    page = mine.where(F.col("id") <= upper)
    followed = page.where("prev_id IS NOT NULL").select(F.col("prev_id").alias("id"))
    page = refs(page, log=F.broadcast(versions.join(F.broadcast(followed), "id", "left_semi")))
    seen = visibility.visible() | visibility.visible("repo_id", F.coalesce("prev_path", "path"))
    return page.where(seen).orderBy("id"), upper


def safe_head(versions: DataFrame, now_ms: int, window_ms: int = WINDOW_MS, tail: int = TAIL) -> int:
    """The head that the feed would reach, from the last ``tail`` rows alone."""
    last = versions.select("id", "created_at").orderBy(F.desc("id")).limit(tail)
    low = last.agg(F.min("id").alias("m")).first()
    if low is None or low.m is None:
        return 0
    return safe_upper(last, int(low.m) - 1, now_ms, window_ms, None)


def index(versions: DataFrame, through: int, after: int = 0, limit: int = INDEX_PAGE) -> DataFrame:
    """The live set as of ``through``, by id: what was live when nothing later had been written."""
    then = live(versions.where(F.col("id") <= through))
    return then.where(F.col("id") > after).select("id", "repo_id", "document_id", "path", "content_hash").orderBy("id").limit(limit)


def with_hashes(versions: DataFrame) -> DataFrame:
    """Missing content hashes filled in."""
    own = columns.content_hash(F.coalesce("frontmatter_raw", F.lit("")), F.col("body"))
    return versions.withColumn("content_hash", F.coalesce("content_hash", own))


# Seconds to the attempt after the first failure, and at most.
RETRY_S, RETRY_MOST_S = 30.0, 3600.0


def retry_delay_s(attempts):
    """Seconds to the next attempt: 30 doubling to an hour."""
    return F.least(F.lit(RETRY_S) * F.pow(F.lit(2.0), attempts - 1), F.lit(RETRY_MOST_S))


def retry_at(now: str, attempts: Column) -> Column:
    """The time of the next attempt after ``attempts`` failures, as text. The few delays there are become
    literals, so the session's time zone doesn't matter."""
    at = dt.datetime.fromisoformat(now).astimezone(dt.UTC)
    text = lambda s: F.lit((at + dt.timedelta(seconds=s)).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z")
    out, n = F.when(attempts < 1, text(RETRY_S)), 1
    while RETRY_S * 2 ** (n - 1) < RETRY_MOST_S:
        out = out.when(attempts == n, text(RETRY_S * 2 ** (n - 1)))
        n += 1
    return out.otherwise(text(RETRY_MOST_S))

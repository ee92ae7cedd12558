"""Line dedup by pairwise alignment.

Overlapping documents are found through hashes of lines: of the shortest run of lines from each line on
that has MIN_WORDS words, and of longer runs where that one is shared. Documents are dealt to HOLDERS
parts, the first document of each part that holds a run is known for every run, and a document is
paired with those of them that are earlier: so every block of lines that some earlier document has too is
held, as a whole or in runs that cover it, by documents it is paired with, and the rarer the run, the
fewer are. Documents of equal lines are one class: they are one block with its first, which stands for them. Each pair is aligned by patience diff, with an ordinary diff of stretches that have no
line unique in both; blocks of consecutive aligned lines are deleted from the later document.

Those pairs may miss what only another holder shows. So lines left that could stand in a block of some earlier
document are aligned with the others that could show it, in growing batches, until they are deleted or none is
left: the result is that of aligning every document with every earlier one.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notegraph.llm.common import SPACE, WORD, durable, held

#: A block of aligned lines of one pair is deleted if it has this many words or more.
MIN_WORDS = 5
#: First holders of each run that are tried before the others. One would leave blocks that it has crossed with others.
HOLDERS = 4
#: Others that are tried at first of those that could show a passage, and how much larger the share of each next batch is.
BATCH, GROWTH = 16, 4
#: Lines of the longer runs.
LONGER = (2, 4, 8, 16)
#: Partners of the first holders of runs with more than MANY occurrences are dealt in PARTS parts.
MANY, PARTS = 16, 32
BLOCKS = T.ArrayType(T.StructType().add("start", "integer").add("stop", "integer"))
#: Bits of a table of a longest common subsequence that is held at once.
TABLE = 1 << 27


def _chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, given in order of the second, that also ascends in the first."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for k, (i, _) in enumerate(pairs):
        at = bisect_left(tails, i)
        back[k] = ends[at - 1] if at else -1
        if at == len(tails):
            tails.append(i)
            ends.append(k)
        else:
            tails[at], ends[at] = i, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _lcs(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched positions of a longest common subsequence: rows of the table as bit vectors, a bit being
    clear where the length grows. Tables of over TABLE bits are halved along ``b`` first."""
    both = set(a) & set(b)
    at = [i for i, x in enumerate(a) if x in both]
    to = [j for j, x in enumerate(b) if x in both]
    out: list[tuple[int, int]] = []
    todo = [(0, len(at), 0, len(to))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 == a1 or b0 == b1:
            continue
        own, other = [a[i] for i in at[a0:a1]], [b[j] for j in to[b0:b1]]
        if len(own) * len(other) > TABLE and len(other) > 1:
            half = len(other) // 2
            ahead = _lengths(_rows(own, other[:half])[-1], len(own))
            back = _lengths(_rows(own[::-1], other[half:][::-1])[-1], len(own))[::-1]
            cut = int(np.argmax(ahead + back))
            todo += [(a0, a0 + cut, b0, b0 + half), (a0 + cut, a1, b0 + half, b1)]
            continue
        rows = _rows(own, other, keep=True)
        i, j = len(own), len(other)
        while i and j:
            bit = 1 << (i - 1)
            if rows[j] & bit:
                i -= 1
            elif not rows[j - 1] & bit:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((at[a0 + i], to[b0 + j]))
    return sorted(out)


def _rows(a: list[int], b: list[int], keep: bool = False) -> list[int]:
    """The rows of the table of ``a`` and ``b``: all with ``keep``, else the last."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows = [full]
    for x in b:
        hit = rows[-1] & where.get(x, 0)
        row = (rows[-1] + hit | rows[-1] - hit) & full
        if keep:
            rows.append(row)
        else:
            rows[0] = row
    return rows


def _lengths(row: int, n: int) -> np.ndarray:
    """The common length of each start of ``a``, from none to all ``n``."""
    bits = np.unpackbits(np.frombuffer(row.to_bytes(n // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[:n]
    return np.append(0, np.cumsum(1 - bits.astype(np.int64)))


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched positions of ``a`` and ``b``: equal lines at both ends of a stretch, then the longest
    ascending chain of lines that occur once in either, then the stretches between them; in a stretch
    without such a line a longest common subsequence."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        place: dict[int, int] = {}
        for i in range(a0, a1):
            place[a[i]] = -1 if a[i] in place else i
        times: dict[int, int] = {}
        for j in range(b0, b1):
            times[b[j]] = times.get(b[j], 0) + 1
        once = [(place[b[j]], j) for j in range(b0, b1) if times[b[j]] == 1 and place.get(b[j], -1) >= 0]
        chain = _chain(once)
        if not chain:
            out += [(a0 + i, b0 + j) for i, j in _lcs(a[a0:a1], b[b0:b1])]
            continue
        out += chain
        for (i, j), (x, y) in zip([(a0 - 1, b0 - 1), *chain], [*chain, (a1, b1)], strict=True):
            if x - i > 1 and y - j > 1:
                todo.append((i + 1, x, j + 1, y))
    return sorted(out)


def _align(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The blocks of the later document that match the earlier one and have ``least`` words, [start, stop), a row for
    each pair."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, y, w in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                words = np.append(0, np.cumsum(w.values.to_numpy(zero_copy_only=False).astype(np.int64)))
                blocks: list[list[int]] = []
                for _, j in patience(x.values.to_pylist(), y.values.to_pylist()):
                    if blocks and blocks[-1][1] == j:
                        blocks[-1][1] = j + 1
                    else:
                        blocks.append([j, j + 1])
                found.append([{"start": i, "stop": j} for i, j in blocks if words[j] - words[i] >= least])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))],
                ["k", "blocks"],
            )

    return align


def _aligned(pairs: DataFrame, own: DataFrame, least: int) -> DataFrame:
    """(k, blocks): the blocks of each document that one of its pairs (k, first, n) shows. The lines of firsts with
    many partners are dealt."""
    part = F.when(F.col("n") > MANY, F.pmod(F.xxhash64("k"), F.lit(PARTS))).otherwise(0).cast("int")
    pairs = durable(pairs.select("k", "first", part.alias("part")))
    lines = own.select(F.col("k").alias("first"), F.col("lines").alias("a"))
    firsts = durable(pairs.select("first", "part").distinct().join(lines, "first"))
    both = pairs.join(firsts, ["first", "part"]).join(own.withColumnRenamed("lines", "b"), "k").select("k", "a", "b", "words")
    schema = T.StructType([own.schema["k"]]).add("blocks", BLOCKS)
    return durable(
        both.mapInArrow(_align(least), schema).select("k", F.explode("blocks").alias("block")).groupBy("k").agg(F.collect_set("block").alias("blocks"))
    )


def passages(lines: list[int], words: list[int], seen: dict[int, int], gone: set[int], least: int) -> dict[tuple[int, ...], list[int]]:
    """The lines that are not ``gone`` but could stand in a block of some earlier document, by shortest passage around
    them that has ``least`` words: a document that shows a block with such a line holds one of its passages, in order.
    ``seen``: lines that earlier documents hold. Lines without words count as held, and are left out of passages but
    for the line itself."""
    out: dict[tuple[int, ...], list[int]] = {}
    solid = [w > 0 or least <= 0 for w in words]
    stop = 0
    while stop < len(lines):
        start = stop
        while stop < len(lines) and (not solid[stop] or lines[stop] in seen):
            stop += 1
        full = [i for i in range(start, stop) if solid[i]]
        total = [0]
        for i in full:
            total.append(total[-1] + words[i])
        if full and total[-1] >= least:
            known: dict[tuple[int, int], list[tuple[int, ...]]] = {}
            after = 0
            for j in range(start, stop):
                # Line j is full[after] or stands before it.
                if j not in gone:
                    if solid[j]:
                        found = [tuple(lines[i] for i in full[x:y]) for x, y in _shortest(total, after, after + 1, least)]
                    else:
                        key = after, lines[j]
                        if key not in known:
                            spans = _shortest(total, after, after, least)
                            known[key] = [(*[lines[i] for i in full[x:after]], lines[j], *[lines[i] for i in full[after:y]]) for x, y in spans]
                        found = known[key]
                    for v in found:
                        out.setdefault(v, []).append(j)
                after += solid[j]
        stop += 1
    return out


def _shortest(total: list[int], low: int, high: int, least: int) -> list[tuple[int, int]]:
    """The spans [x, y) with x <= ``low`` and y >= ``high`` whose sum is ``least`` or more and which hold no other such."""
    out: list[tuple[int, int]] = []
    y = len(total) - 1
    for x in range(low, -1, -1):
        if total[y] - total[x] < least:
            continue
        while y > high and total[y - 1] - total[x] >= least:
            y -= 1
        if not out or out[-1][1] != y:
            out.append((x, y))
        if y == high:
            break
    return out


def _lacks(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row (k, passage, rare, at) for each of the ``passages`` of a document, ``rare`` being the line of it that the
    fewest documents hold."""

    def lacks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, keys, rare, at = [], [], [], []
            for row in range(batch.num_rows):
                lines, words, seen, blocks = (batch.column(c)[row].as_py() for c in range(1, 5))
                times = {x["h"]: x["n"] for x in seen}
                gone = {i for x in blocks or [] for i in range(x["start"], x["stop"])}
                for v, js in passages(lines, words, times, gone, least).items():
                    of.append(row)
                    keys.append(v)
                    rare.append(min((times[h], h) for h in v if h in times)[1])
                    at.append(js)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of, pa.int64())), pa.array(keys, pa.list_(pa.int64())), pa.array(rare, pa.int64()), pa.array(at, pa.list_(pa.int32()))],
                ["k", "passage", "rare", "at"],
            )

    return lacks


def _holds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(first, id): the passages that each document holds in order, with other lines between or not."""
    for batch in batches:
        of, ids = [], []
        for row in range(batch.num_rows):
            lines, asks = batch.column(1)[row].as_py(), batch.column(2)[row].as_py()
            wanted = {h for x in asks for h in x["passage"]}
            places: dict[int, list[int]] = {}
            for i, h in enumerate(lines):
                if h in wanted:
                    places.setdefault(h, []).append(i)
            for x in asks:
                to = -1
                for h in x["passage"]:
                    own = places.get(h, [])
                    k = bisect_left(own, to + 1)
                    if k == len(own):
                        break
                    to = own[k]
                else:
                    of.append(row)
                    ids.append(x["id"])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), pa.array(ids, pa.int64())], ["first", "id"])


def rest_of(own: DataFrame, done: DataFrame, least: int) -> list[DataFrame]:
    """(k, blocks), as ``done`` has them of the pairs aligned so far, from all further pairs that could show a line that is
    not in a block yet. ``own``: (k, lines, words), a row for each document."""
    key = own.schema["k"]
    full = F.filter("lines", lambda h, i: (F.get("words", i) > 0) | F.lit(least <= 0))
    lines = own.select("k", F.explode(F.array_distinct(full)).alias("h"))
    ends = (F.count(F.lit(1)).alias("n"), F.min("k").alias("first"))
    shared = durable(lines.groupBy("h").agg(*ends).where("n > 1"))
    seen = lines.join(shared, "h").where("first < k").groupBy("k").agg(F.collect_list(F.struct("h", "n")).alias("seen"))
    open_ = own.join(seen, "k").join(done, "k", "left").select("k", "lines", "words", "seen", "blocks")
    schema = T.StructType([key]).add("passage", T.ArrayType(T.LongType())).add("rare", "long").add("at", T.ArrayType(T.IntegerType()))
    left = durable(open_.mapInArrow(_lacks(least), schema).withColumn("id", F.xxhash64("passage")))
    if left.isEmpty():
        return []
    asked = durable(left.groupBy("id").agg(F.first("passage").alias("passage"), F.first("rare").alias("h"), F.max("k").alias("last")))
    asks = asked.join(lines, "h").where("k < last").groupBy("k").agg(F.collect_list(F.struct("id", "passage")).alias("asks"))
    held_by = T.StructType().add("first", key.dataType).add("id", "long")
    found = durable(own.join(asks, "k").select("k", "lines", "asks").mapInArrow(_holds, held_by))
    sizes = durable(found.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("least")))
    others = durable(found.join(sizes, "id").drop("least"))
    left = durable(left.join(sizes, "id").where("least < k").select("k", "id", "at"))
    most = sizes.agg(F.max("n")).first()[0]
    out: list[DataFrame] = []
    # Documents stand by hash on the way from 0 to 1, of which a passage that ``n`` hold has come so far after each batch.
    on = F.xxhash64("first") / F.lit(2.0**64) + 0.5
    size = BATCH
    while True:
        to = F.lit(float(size)) / F.col("n")
        now = (to >= 1) | (on < to)
        if size > BATCH:
            before = to / GROWTH
            now &= (before < 1) & (on >= before)
        if left.isEmpty():
            break
        pairs = left.select("k", "id").join(others.where(now), "id").where("first < k").groupBy("k", "first").agg(F.max("n").alias("n"))
        out.append(_aligned(pairs, own, least))
        if most is None or size >= most:
            break
        gone = lambda j: F.exists("blocks", lambda b: (b["start"] <= j) & (j < b["stop"]))
        at = F.when(F.col("blocks").isNull(), F.col("at")).otherwise(F.filter("at", lambda j: ~gone(j)))
        # What no further batch holds is settled.
        more = sizes.where(F.col("n") > size).select("id")
        left = durable(left.join(more, "id").join(out[-1], "k", "left").select("k", "id", at.alias("at")).where(F.size("at") > 0))
        size *= GROWTH
    return out


def deleted(lines: list[str], blocks: list[tuple[int, int]], least: int) -> list[int]:
    """The positions of the lines in blocks with ``least`` words or more."""
    words = [0]
    for x in lines:
        words.append(words[-1] + len(x.encode().split()))
    gone: set[int] = set()
    for start, stop in blocks:
        if words[stop] - words[start] >= least:
            gone.update(range(start, stop))
    return sorted(gone)


def _words(line: Column, most: int) -> Column:
    """The number of words, or ``most`` where there are more: most lines need not be read to the end for it."""
    count = F.least(F.regexp_count(line, F.lit(WORD)), F.lit(most))
    if not 1 <= most <= 64:
        return count
    return F.when(line.rlike(rf"\A(?:{SPACE[:-1]}*+)(?:{WORD}+{SPACE}+){{{most - 1}}}{WORD[:-1]}"), F.lit(most)).otherwise(count)


def _places(rows: DataFrame, into: str = "solid") -> DataFrame:
    """``rows`` with the lines that are not empty, in order: (at, h, w)."""
    empty = F.xxhash64(F.lit(""))
    every_ = F.transform("lines", lambda h, i: F.struct(i.alias("at"), h.alias("h"), F.get("words", i).alias("w")))
    return held(rows, into, F.filter(every_, lambda x: x["h"] != empty))


def pairs_of(sketch: DataFrame, key: Column, min_words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(k, first, n): the earlier documents that each is to be aligned with first, and the most occurrences that a run has
    over which they met, ``rest_of`` has the others; (k, stop) of those whose lines are all equal to an earlier one's,
    with their number of lines; and (k, lines, words) of those that are not. Columns of ``sketch``: those of ``key``,
    lines, words."""
    docs = sketch.select(key.alias("k"), "lines", "words")
    ends = (F.count(F.lit(1)).alias("n"), F.min("k").alias("first"), F.max("k").alias("other"))
    held_by = F.array(*[F.min(F.when(F.pmod(F.xxhash64("k"), F.lit(HOLDERS)) == i, F.col("k"))) for i in range(HOLDERS)])
    # Written, so that both sides of the joins are plain exchanges and what is very common can be split.
    classes = durable(docs.select("k", F.xxhash64("lines").alias("whole")).groupBy("whole").agg(*ends).where("first <> other").drop("other"))
    placed = docs.withColumn("whole", F.xxhash64("lines")).join(classes, "whole", "left")
    copies = placed.where("k <> first").select("k", F.size("lines").alias("stop")).distinct()
    # Rows repeated whole would double their pairs.
    own = durable(placed.where("first IS NULL OR k = first").select("k", "lines", "words").dropDuplicates(["k"]))

    def shared(runs: DataFrame) -> DataFrame:
        """The rows (k, run) of runs that several documents hold, with the first holders."""
        held_ = durable(runs.groupBy("run").agg(*ends, held_by.alias("firsts")).where("first <> other").drop("first", "other"))
        return durable(runs.join(held_, "run").drop("run"))

    line = lambda i, k, name: F.get("solid", i + k)[name]
    words = lambda i, n: sum((line(i, k, "w") for k in range(1, n)), line(i, 0, "w"))
    shortest = lambda i: F.coalesce(
        *[F.when(words(i, n) >= min_words, F.xxhash64(F.lit(n), *[line(i, k, "h") for k in range(n)])) for n in range(1, max(1, min_words) + 1)]
    )
    at = F.sequence(F.lit(0), F.size("solid") - 1)
    solid = _places(own).where(F.size("solid") > 0).drop("lines", "words")
    starts = solid.select("k", F.posexplode(F.transform(at, shortest)).alias("i", "run")).where(F.col("run").isNotNull())
    met = shared(starts)
    of = met.groupBy(F.col("k").alias("_k")).agg(F.collect_set("i").alias("starts"))
    longer = solid.join(of, F.col("k") == F.col("_k")).drop("_k")
    run = lambda i, n: F.when(i + n <= F.size("solid"), F.xxhash64(F.lit(-n), F.transform(F.slice("solid", i + 1, n), lambda x: x["h"])))
    runs = F.flatten(F.transform("starts", lambda i: F.array(*[run(i, n) for n in LONGER])))
    more = shared(longer.select("k", F.explode(runs).alias("run")).where(F.col("run").isNotNull()))
    found = met.select("k", "firsts", "n").unionByName(more.select("k", "firsts", "n")).select("k", F.explode("firsts").alias("first"), "n")
    return found.where("first < k").groupBy("k", "first").agg(F.max("n").alias("n")), copies, own


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_lines, removed, text) for each row of ``docs``: its number of lines, the positions
    of the lines removed, and the text of the others.

    Lines end at line feeds and are equal when identical after trimming spaces and lower-casing. The
    earlier of two documents is that with the smaller identifier; null identifiers come last, and
    different texts with one identifier are ordered by a hash. Rows repeated whole are one document and
    give equal rows. A null text counts as empty: one empty line. Lines without words align but are
    deleted only within a block that has words enough. Other columns are ignored; an empty table gives
    an empty result.
    """
    raw = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(raw).alias("mark"),
        raw.alias("text"),
    )
    split = F.split("text", "\n")
    line_hashes = F.transform(split, lambda x: F.xxhash64(F.lower(F.trim(x))))
    counts = F.transform(split, lambda x: _words(x, min_words))
    sketch = durable(rows.select("doc_id", "mark", line_hashes.alias("lines"), counts.alias("words")))
    key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")
    pairs, same, own = pairs_of(sketch, key, min_words)
    aligned = _aligned(pairs, own, min_words)
    whole = same.select("k", F.array(F.struct(F.lit(0).alias("start"), "stop")).alias("blocks"))
    for more in rest_of(own, aligned, min_words):
        whole = whole.unionByName(more)
    blocks = aligned.unionByName(whole).select("k", F.explode("blocks").alias("block"))
    drops = blocks.groupBy(F.col("k.doc_id").alias("d"), F.col("k.mark").alias("m")).agg(F.collect_set("block").alias("blocks"))
    joined = rows.join(drops, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            counts = np.zeros(batch.num_rows, dtype=np.int64)
            removed: list[list[int]] = []
            for i, (text, blocks) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                lines = text.split("\n")
                counts[i] = len(lines)
                gone = deleted(lines, [(x["start"], x["stop"]) for x in blocks], min_words) if blocks else []
                removed.append(gone)
                drop = set(gone)
                texts.append("\n".join(x for k, x in enumerate(lines) if k not in drop) if gone else text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts), pa.array(removed, pa.list_(pa.int32())), pa.array(texts, pa.string())],
                ["doc_id", "n_lines", "removed", "text"],
            )

    schema = T.StructType().add("doc_id", "long").add("n_lines", "long").add("removed", T.ArrayType(T.IntegerType())).add("text", "string")
    return joined.select("doc_id", "text", "blocks").mapInArrow(cut, schema)

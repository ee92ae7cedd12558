"""Links: extraction, targets, resolution, maintenance, stale links and their repair (LN1-LN13)."""

from __future__ import annotations

import json
import posixpath
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from notegraph.config import LinkConfig, Syntaxes
from notegraph.functions.columns import fold_path
from notegraph.functions.text import units

BODY = "$body"


@dataclass(frozen=True)
class Edge:
    field: str
    target: str
    wiki: bool
    start: int = -1  # code points of the written target in the body
    end: int = -1


# Scanning

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})([^\n]*)$")
_DEFINITION = re.compile(r"^ {0,3}\[((?:\\.|[^\[\]\\])+)\]:[ \t]*\n?[ \t]*(?:<([^<>\n]*)>|(\S+))", re.M)
_SPECIAL = re.compile(r"[\\\[\]]")
_WIKI_STOP = re.compile(r"[\]\n]")
# What may stand before a path written in the text, and what ends it.
_BEFORE_PATH = frozenset("([\"'`<>")
_PATH_RUN = re.compile(r"""[^\s\])"'`<>]*""")
PAGE = ".md"


class Ranges:
    """Ranges of a text, merged where they meet; looked up by bisection."""

    def __init__(self, found: list[tuple[int, int]]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(found):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def end_at(self, at: int) -> int | None:
        """The end of the range that holds ``at``."""
        k = bisect_right(self.starts, at) - 1
        return self.ends[k] if k >= 0 and at < self.ends[k] else None

    def __contains__(self, at: int) -> bool:
        return self.end_at(at) is not None


def code_ranges(text: str) -> list[tuple[int, int]]:
    """Fenced and indented blocks and code spans."""
    out: list[tuple[int, int]] = []
    at, fence, begin, blank = 0, "", 0, True
    plain: list[tuple[int, int]] = []
    for line in text.splitlines(keepends=True):
        bare = line.rstrip("\r\n")
        m = _FENCE.match(bare)
        if fence:
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                out.append((begin, at + len(line)))
                fence = ""
        elif m and not (m[1][0] == "`" and "`" in m[2]):
            fence, begin = m[1], at
        elif blank and re.match(r"(?: {4}|\t)\s*\S", bare):
            out.append((at, at + len(line)))
        else:
            plain.append((at, at + len(line)))
            blank = not bare.strip()
        at += len(line)
    if fence:
        out.append((begin, len(text)))
    merged: list[list[int]] = []
    for a, b in plain:
        if merged and merged[-1][1] == a:
            merged[-1][1] = b
        else:
            merged.append([a, b])
    for a, b in merged:
        k = a
        while (k := text.find("`", k, b)) >= 0:
            if k > a and text[k - 1] == "\\":
                k += 1
                continue
            run = len(text[k:b]) - len(text[k:b].lstrip("`"))
            close = re.compile(rf"(?<!`)`{{{run}}}(?!`)").search(text, k + run, b)
            if close:
                out.append((k, close.end()))
                k = close.end()
            else:
                k += run
    return sorted(out)


def _label(raw: str) -> str:
    return " ".join(raw.split()).lower()


def _destination(text: str, at: int) -> tuple[str, int, int, int] | None:
    """(target, start, end, after the closing bracket) of ``(target "title")`` at ``at``."""
    m = re.compile(r"\([ \t\n]*").match(text, at)
    if not m:
        return None
    k = m.end()
    if text.startswith("<", k):
        stop = re.compile(r"[^<>\n\\]*(?:\\.[^<>\n\\]*)*>").match(text, k + 1)
        if not stop:
            return None
        start, end, k = k + 1, stop.end() - 1, stop.end()
    else:
        start, depth = k, 0
        while k < len(text) and not text[k].isspace():
            if text[k] == "\\" and k + 1 < len(text):
                k += 2
                continue
            if text[k] == "(":
                depth += 1
            elif text[k] == ")":
                if not depth:
                    break
                depth -= 1
            k += 1
        end = k
    m = re.compile(r"""(?:[ \t\n]+(?:"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|\((?:\\.|[^()\\])*\)))?[ \t\n]*\)""").match(text, k)
    return (text[start:end], start, end, m.end()) if m else None


def _markdown(text: str, code: Ranges, config: Syntaxes, wiki: list[tuple[int, int]]) -> list[tuple[int, Edge]]:
    known: dict[str, tuple[str, int, int]] = {}
    defined: list[tuple[int, int]] = []
    for m in _DEFINITION.finditer(text):
        if m.start() not in code:
            g = 2 if m[2] is not None else 3
            known.setdefault(_label(m[1]), (m[g], *m.span(g)))
            defined.append(m.span())
    skip = Ranges([*zip(code.starts, code.ends, strict=True), *wiki, *defined])
    out: list[tuple[int, Edge]] = []
    open_: list[tuple[int, bool]] = []
    k = 0
    while m := _SPECIAL.search(text, k):
        k, c = m.start(), m.group()
        if (end := skip.end_at(k)) is not None:
            k = end
            continue
        if c == "\\":
            k += 2
            continue
        if c == "[":
            open_.append((k, k > 0 and text[k - 1] == "!" and (k < 2 or text[k - 2] != "\\")))
        elif c == "]" and open_:
            begin, image = open_.pop()
            found, after = None, k + 1
            got = _destination(text, k + 1)
            if got:
                found, after = (got[0], got[1], got[2], config.inline), got[3]
            else:
                ref = re.compile(r"\[((?:\\.|[^\[\]\\])*)\]").match(text, k + 1)
                label = _label(ref[1]) if ref and ref[1].strip() else _label(text[begin + 1 : k])
                if label in known:
                    found, after = (*known[label], config.reference), ref.end() if ref else k + 1
            if found:
                if found[0] and found[3]:
                    out.append((begin - image, Edge(BODY, found[0], False, found[1], found[2])))
                if not image:
                    open_ = [x for x in open_ if x[1]]  # links hold no links
                k = after
                continue
        k += 1
    return out


def _wikilinks(text: str, code: Ranges) -> list[tuple[int, int, Edge]]:
    """Links ``[[page|label]]`` of one line; a ``!`` before it embeds the page."""
    out = []
    at = text.find("[[")
    while at >= 0 and (m := _WIKI_STOP.search(text, at + 2)):
        stop = m.start()
        if stop == at + 2 or not text.startswith("]]", stop):
            at = text.find("[[", stop)
            continue
        begin = at - (text[at - 1 : at] == "!")
        page = text[at + 2 : stop].split("|", 1)[0]
        target = page.strip()
        if target and begin not in code:
            start = at + 2 + len(page) - len(page.lstrip())
            out.append((begin, stop + 2, Edge(BODY, target, True, start, start + len(target))))
        at = text.find("[[", stop + 2)
    return out


def _paths(text: str, code: Ranges) -> Iterator[tuple[int, Edge]]:
    """Paths from the root to a page that stand in the text by themselves, with the anchor that follows."""
    at = text.find("/")
    while at >= 0:
        end = at + 1
        if at == 0 or text[at - 1].isspace() or text[at - 1] in _BEFORE_PATH:
            run = _PATH_RUN.match(text, at).group()
            end = at + len(run)
            page = run.rfind(PAGE)
            if page > 1:
                after = page + len(PAGE)
                end = end if run.startswith("#", after) else at + after
                if at not in code:
                    yield at, Edge(BODY, text[at:end], False, at, end)
        at = text.find("/", end)


def _is_path(value: str) -> bool:
    """Whether a string is, as a whole, a path from the root to a page, with an anchor or not."""
    page = value.split("#", 1)[0]
    return "\n" not in value and page.startswith("/") and page.endswith(PAGE) and len(page) > 1 + len(PAGE) and not any(c.isspace() for c in page)


def _scan(text: str, config: Syntaxes, paths: bool) -> list[Edge]:
    code = Ranges(code_ranges(text))
    wiki = _wikilinks(text, code) if config.wikilink else []
    hits = [(a, e) for a, _, e in wiki] + _markdown(text, code, config, [(a, b) for a, b, _ in wiki])
    if paths and config.fullpath:
        hits += _paths(text, code)
    taken: set[tuple[int, int]] = set()
    out = []
    for _, e in sorted(hits, key=lambda h: h[0]):
        if (e.start, e.end) not in taken or e.start < 0:
            out.append(e)
        taken.add((e.start, e.end))
    return out


def extract(body: str, frontmatter: object, config: LinkConfig = LinkConfig()) -> list[Edge]:
    """Edges of the body in order, then those of front matter strings under their dotted key paths."""
    out = _scan(body, config.body, True)
    own = config.frontmatter

    def walk(node: object, path: list[str]) -> None:
        if isinstance(node, str):
            name = ".".join(path)
            if own.fullpath and _is_path(node.strip()):
                out.append(Edge(name, node.strip(), False))
            else:
                out.extend(Edge(name, e.target, e.wiki) for e in _scan(node, own, False))
        elif isinstance(node, list):
            for x in node:
                walk(x, path)
        elif isinstance(node, dict):
            for key, x in node.items():
                walk(x, [*path, str(key)])

    walk(frontmatter, [])
    return out


def targets(edge: Edge, source: str, config: LinkConfig = LinkConfig()) -> tuple[str, list[str]]:
    """(target as recorded, candidate paths in order). No candidates: outside the repository."""
    page, mark, anchor = edge.target.partition("#")
    kept = mark + anchor if config.anchors else ""
    if not page or re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", page):
        return edge.target, []
    absolute = page.startswith("/") or edge.wiki
    base = "" if absolute else posixpath.dirname(source)
    parts: list[str] = [p for p in base.split("/") if p]
    for p in page.split("/"):
        if p == "..":
            if not parts:
                return page + kept, []
            parts.pop()
        elif p not in ("", "."):
            parts.append(p)
    if not parts:
        return page + kept, []
    path = "/".join(parts)
    if edge.wiki and config.elision and not path.endswith(".md"):
        return f"{path}.md{kept}", [f"{path}.md", f"{path}/{config.index_name}.md"]
    return path + kept, [path]


EDGE_SCHEMA = T.ArrayType(
    T.StructType()
    .add("ord", T.IntegerType()).add("field", T.StringType()).add("target_raw", T.StringType())
    .add("candidates", T.ArrayType(T.StringType())).add("start", T.IntegerType()).add("end", T.IntegerType())
    .add("wiki", T.BooleanType())
)


Configs = LinkConfig | dict[int, LinkConfig]


def config_of(configs: Configs, repo: int | None) -> LinkConfig:
    """The configuration of a repository: the only one, or its own among ``configs``, or the default."""
    return configs if isinstance(configs, LinkConfig) else configs.get(repo, LinkConfig())


def edges_udf(configs: Configs = LinkConfig()):
    @F.pandas_udf(EDGE_SCHEMA)
    def edges(repo: pd.Series, path: pd.Series, body: pd.Series, frontmatter: pd.Series) -> pd.Series:
        def one(r: int | None, p: str, b: str | None, f: str | None) -> list[dict]:
            out = []
            config = config_of(configs, r)
            for i, e in enumerate(extract(b or "", json.loads(f) if f else {}, config)):
                raw, found = targets(e, p, config)
                out.append({"ord": i, "field": e.field, "target_raw": raw, "candidates": found, "start": e.start, "end": e.end, "wiki": e.wiki})
            return out

        return pd.Series([one(*x) for x in zip(repo, path, body, frontmatter, strict=True)])

    return edges


def extracted(live: DataFrame, configs: Configs = LinkConfig()) -> DataFrame:
    """(repo_id, source_id, path, ord, field, target_raw, candidates, start, end, wiki) without external targets.
    ``configs``: one for all, or one a repository (``writes.Repos.links``)."""
    found = edges_udf(configs)(F.col("repo_id"), F.col("path"), F.col("body"), F.to_json("frontmatter"))
    return (
        live.select("repo_id", F.col("document_id").alias("source_id"), "path", F.explode(found).alias("e"))
        .select("repo_id", "source_id", "path", "e.*")
        .where(F.size("candidates") > 0)
    )


def resolved(edges: DataFrame, live: DataFrame) -> DataFrame:
    """Rows of the links table: the first candidate path that is live binds; otherwise the first one
    dangles. Links of a document to itself are dropped and ``ord`` is dense."""
    tried = edges.select("*", F.posexplode("candidates").alias("rank", "candidate")).withColumn("norm", fold_path("candidate"))
    at = live.select("repo_id", F.col("path_norm").alias("norm"), F.col("document_id").alias("found"))
    tried = tried.join(at, ["repo_id", "norm"], "left")
    best = tried.groupBy("repo_id", "source_id", "ord", "field", "target_raw").agg(
        F.min_by(F.struct("norm", "found"), F.struct(F.col("found").isNull(), "rank")).alias("b")
    )
    rows = best.select(
        "repo_id", "source_id", F.col("ord").alias("_o"), "field", "target_raw",
        F.col("b.norm").alias("target_norm"), F.col("b.found").alias("target_id"),
    ).where("target_id IS NULL OR target_id <> source_id")
    dense = F.row_number().over(Window.partitionBy("source_id").orderBy("_o")) - 1
    return rows.select("repo_id", "source_id", dense.cast("int").alias("ord"), "field", "target_raw", "target_norm", "target_id")


def backfill(live: DataFrame, configs: Configs = LinkConfig()) -> DataFrame:
    """The whole links table, derived again."""
    readable = live.where(~F.col("path").startswith(":"))
    return resolved(extracted(readable, configs), live)


def reindexed(links: DataFrame, live: DataFrame, repo: int, config: LinkConfig) -> DataFrame:
    """``links`` with those of one repository read again, as after its configuration has changed."""
    own = live.where(F.col("repo_id") == repo)
    return links.where(~F.col("repo_id").eqNullSafe(F.lit(repo))).unionByName(backfill(own, config).select(*links.columns))


def replaced(links: DataFrame, fresh: DataFrame, sources: DataFrame) -> DataFrame:
    """``links`` with the rows of the documents in ``sources`` replaced by ``fresh``."""
    return links.join(sources.select(F.col("document_id").alias("source_id")).distinct(), "source_id", "left_anti").unionByName(fresh)


def cleared(links: DataFrame, sources: DataFrame) -> DataFrame:
    """``links`` without those of the documents in ``sources``, as after their deletion; links to them stay."""
    return links.join(sources.select(F.col("document_id").alias("source_id")).distinct(), "source_id", "left_anti")


def totals(links: DataFrame) -> DataFrame:
    """One row: documents with links, links, and how many of them dangle."""
    return links.agg(
        F.count_distinct("source_id").alias("documents"),
        F.count(F.lit(1)).alias("edges"),
        F.count_if(F.col("target_id").isNull()).alias("dangling"),
    )


def bind_danglers(links: DataFrame, live: DataFrame) -> DataFrame:
    """Unresolved links whose target path has become live are bound, but never to their own document."""
    at = live.select("repo_id", F.col("path_norm").alias("target_norm"), F.col("document_id").alias("_now"))
    joined = links.join(at, ["repo_id", "target_norm"], "left")
    bound = F.coalesce("target_id", F.when(F.col("_now") != F.col("source_id"), F.col("_now")))
    return joined.withColumn("target_id", bound).select(*links.columns)


def stale(links: DataFrame, live: DataFrame) -> DataFrame:
    """(repo_id, source_id, ord, field, target_raw, target_norm, target_id, current_path): bound links
    whose target has another path now than the one written."""
    now = live.select(F.col("document_id").alias("target_id"), F.col("path").alias("current_path"), F.col("path_norm").alias("_n"))
    found = links.join(now, "target_id").where("_n <> target_norm").drop("_n")
    return found.select(*links.columns, "current_path")


def repaired(body: str, edges: list[dict], config: LinkConfig = LinkConfig()) -> str:
    """``body`` with the written targets of ``edges`` (start, end, wiki, current_path, target) replaced,
    from the last to the first, each span once. Anchors stay; a wikilink drops the extension."""
    done: set[int] = set()
    for e in sorted(edges, key=lambda e: -e["start"]):
        if e["start"] < 0 or e["start"] in done:
            continue
        done.add(e["start"])
        written_ = body[e["start"] : e["end"]]
        anchor = written_[written_.index("#") :] if "#" in written_ else ""
        path = e["current_path"]
        new = (path.removesuffix(".md") if config.elision else path) if e["wiki"] else "/" + path
        body = body[: e["start"]] + new + anchor + body[e["end"] :]
    return body


def repair(store_live: DataFrame, links: DataFrame, configs: Configs = LinkConfig()) -> DataFrame:
    """(source_id, path, body): the bodies of documents with stale links, rewritten. Stored rows are
    matched to written ones by target, not by place: a link of a document to itself holds no place."""
    old = stale(links, store_live).where(F.col("field") == BODY).select("source_id", "target_raw", "current_path").distinct()
    spans = extracted(store_live, configs).where(F.col("field") == BODY)
    joined = spans.join(old, ["source_id", "target_raw"])
    fixes = joined.groupBy("source_id").agg(F.collect_list(F.struct("start", "end", "wiki", "current_path")).alias("edges"))
    bodies = store_live.select("repo_id", F.col("document_id").alias("source_id"), "path", "body").join(fixes, "source_id")

    @F.pandas_udf("string")
    def fixed(repo: pd.Series, body: pd.Series, edges: pd.Series) -> pd.Series:
        rows = zip(repo, body, edges, strict=True)
        return pd.Series([repaired(b, [dict(e) for e in es], config_of(configs, r)) for r, b, es in rows])

    return bodies.select("source_id", "path", fixed("repo_id", "body", "edges").alias("body"))


def utf16_span(body: str, start: int, end: int) -> tuple[int, int]:
    """A span of code points in the units that other clients count."""
    return units(body[:start]), units(body[:end])

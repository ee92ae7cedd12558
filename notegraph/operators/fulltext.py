"""Full-text search: positional postings, all-terms, phrase and any-term matches, and BM25 (FT1-FT8)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegraph.functions import columns, text

K1, B = 1.2, 0.75


@dataclass(frozen=True)
class TextQuery:
    """Every group must hold: a phrase of consecutive terms, or alternatives of one term each."""

    phrases: tuple[tuple[str, ...], ...]
    alternatives: tuple[tuple[str, ...], ...] = ()

    @property
    def words(self) -> list[str]:
        return sorted({t for g in (*self.phrases, *self.alternatives) for t in g})


def parse(query: str, stemmed: bool = True) -> TextQuery:
    """Words and quoted phrases, all required; OR between words makes alternatives. Anything malformed
    is read as words: this never raises."""
    form = (lambda t: [text.stem(x) for x in text.terms(t)]) if stemmed else text.terms
    phrases, alternatives = [], []
    pieces = re.findall(r'"([^"]*)"|([^\s"]+)', query)
    k = 0
    while k < len(pieces):
        quoted, word = pieces[k]
        if quoted:
            if found := tuple(form(quoted)):
                phrases.append(found)
            k += 1
            continue
        group = [word]
        while k + 2 < len(pieces) and pieces[k + 1][1] == "OR" and pieces[k + 2][1]:
            group.append(pieces[k + 2][1])
            k += 2
        k += 1
        terms = [form(w) for w in group if w != "OR"]
        if len(terms) > 1:
            alternatives.append(tuple(t for f in terms for t in f))
        else:
            phrases += [(t,) for f in terms for t in f]
    return TextQuery(tuple(phrases), tuple(a for a in alternatives if a))


def tokens(rows: DataFrame, stemmed: bool = True, body: str = "body") -> DataFrame:
    """(id, terms): what an index holds of each row. The generator keeps the optimiser from copying the
    tokeniser into every condition on the terms."""
    found = columns.stemmed_terms(F.coalesce(F.col(body), F.lit(""))) if stemmed else columns.plain_terms(F.col(body))
    return rows.select("id", F.explode(F.array(found)).alias("terms"))


def postings(indexed: DataFrame) -> DataFrame:
    """(id, term, pos)."""
    return indexed.select("id", F.posexplode("terms").alias("pos", "term")).select("id", "term", "pos")


def _holds(phrase: tuple[str, ...]) -> Column:
    """Terms have no spaces, so consecutive ones are a substring of all terms joined by spaces."""
    if len(phrase) == 1:
        return F.array_contains("terms", phrase[0])
    joined = F.concat(F.lit(" "), F.array_join("terms", " "), F.lit(" "))
    return F.contains(joined, F.lit(" " + " ".join(phrase) + " "))


def matches(indexed: DataFrame, query: TextQuery) -> DataFrame:
    """Rows of the index that hold every group. Nothing matches a query without terms."""
    if not query.words:
        return indexed.limit(0)
    found = F.lit(True)
    for p in query.phrases:
        found = found & _holds(p)
    for a in query.alternatives:
        found = found & F.arrays_overlap("terms", F.array(*[F.lit(t) for t in a]))
    return indexed.where(found)


def _times(word: str) -> Column:
    return F.size(F.filter("terms", lambda t: t == word))


def bm25(indexed: DataFrame, query: TextQuery) -> DataFrame:
    """(id, score) of the matches, higher is better. One pass gathers the number of rows, their mean
    length and in how many each term of the query occurs; it gives a single row."""
    words = query.words
    held = [F.count_if(F.array_contains("terms", w)).alias(f"df{i}") for i, w in enumerate(words)]
    stats = indexed.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("terms")).alias("mean"), *held)
    score = F.lit(0.0)
    for i, w in enumerate(words):
        tf = _times(w).cast("double")
        idf = F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5) + 1)
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.size("terms") / F.col("mean")))
    # The other side is the one row of totals.
    return matches(indexed, query).join(F.broadcast(stats)).select("id", score.alias("score"))

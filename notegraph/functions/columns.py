"""Column forms of the document functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notegraph.functions import text


@F.pandas_udf(T.StringType())
def fold_path(path: pd.Series) -> pd.Series:
    """The identity key of a path; the engine has no Unicode normalisation of its own."""
    return path.map(text.fold, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def stemmed_terms(body: pd.Series) -> pd.Series:
    return body.map(lambda b: [text.stem(t) for t in text.terms(b)], na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def chunk_texts(body: pd.Series) -> pd.Series:
    return body.map(text.chunks, na_action="ignore")


@F.pandas_udf(T.StructType().add("json", T.StringType()).add("error", T.StringType()))
def parsed_frontmatter(raw: pd.Series) -> pd.DataFrame:
    def one(r: str | None) -> tuple[str | None, str | None]:
        try:
            return text.to_json(text.parse(r or "")), None
        except text.EngineError as e:
            return None, str(e)

    return pd.DataFrame([one(r) for r in raw], columns=["json", "error"])


@F.pandas_udf(T.StringType())
def diffed(old: pd.Series, new: pd.Series, old_name: pd.Series, new_name: pd.Series) -> pd.Series:
    return pd.Series([text.unified_diff(*x) for x in zip(old, new, old_name, new_name, strict=True)])


def plain_terms(body: Column) -> Column:
    """Unstemmed terms: lower-cased runs of letters and digits, inside the JVM."""
    return F.array_remove(F.split(F.lower(F.coalesce(body, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def canonical(raw: Column, body: Column) -> Column:
    ended = F.when(raw.endswith("\n"), raw).otherwise(F.concat(raw, F.lit("\n")))
    return F.when(F.coalesce(raw, F.lit("")) == "", F.coalesce(body, F.lit(""))).otherwise(
        F.concat(F.lit("---\n"), ended, F.lit("---\n"), F.coalesce(body, F.lit("")))
    )


def content_hash(raw: Column, body: Column) -> Column:
    return F.sha2(canonical(raw, body), 256)


def operation(path: Column, previous: Column, system: str = ":") -> Column:
    """create, update, delete or move, by the path before and after."""
    gone = path.startswith(system) | path.contains("/" + system)
    return (
        F.when(previous.isNull(), "create").when(path == previous, "update").when(gone, "delete").otherwise("move")
    )


def deleted_path(path: Column, version: Column, system: str = ":") -> Column:
    """``text.deleted_path`` for columns."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    folder = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)
    ext = F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)
    base = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    return F.concat(F.lit(system + "deleted/"), folder, base, F.lit("-v"), version.cast("string"), ext)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 minus the cosine, in double; NULL where a vector is null, empty, zero or of another size."""
    dot = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v
    )
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), 1 - dot(a, b) / norm)


def version_ref(id: Column) -> Column:
    return F.concat(F.lit("v"), id.cast("string"))


def version_number(ref: Column) -> Column:
    return F.regexp_extract(ref, r"^v([1-9][0-9]*)$", 1).try_cast("long")

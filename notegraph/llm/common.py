"""Helpers shared by the operators: durable intermediate tables and text normalisation."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The separators of words; a word is a run of anything else.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        app = spark.sparkContext.applicationId
        at = _local[app] if app in _local else _local.setdefault(app, tempfile.mkdtemp(prefix="notegraph-"))
    return at.rstrip("/")


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/notegraph-{spark.sparkContext.applicationId}"


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Remove the tables that this application's operators have written. Results that were not stored
    elsewhere can't be read after it."""
    _remove(spark, _folder(spark))


#: Folders written in each open ``scratch``, innermost last.
_open: list[list[str]] = []


def durable(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: later plans start from it,
    so a lost executor costs the reading of a file, not the work before it."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _open:
        _open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside are removed at the end, but for those that are given to what it yields, which writes
    them. Nothing else from inside can be read after it."""
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        out = durable(df)
        kept.append(_open[-1].pop())
        return out

    _open.append([])
    try:
        yield keep
    finally:
        for path in _open.pop():
            _remove(spark, path)
        if _open:
            _open[-1].extend(kept)


def trim() -> None:
    """Give back what this process has freed: allocators keep the most that was ever taken."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z alone lower-cased; null counts as empty.

    ``lower`` is many times faster than ``translate`` and agrees with it where all is ASCII.
    """
    whole = F.coalesce(text, F.lit(""))
    return F.when(F.length(whole) == F.octet_length(whole), F.lower(whole)).otherwise(
        F.translate(whole, UPPER, UPPER.lower())
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with ``value`` computed once. The optimiser copies the expression behind a plain column
    into every filter and lambda that uses it; it can't do so through a generator."""
    return rows.select(*[F.col(c) for c in rows.columns if c != name], F.explode(F.array(value)).alias(name))


def named(column: str) -> Column:
    """The column of that name, whatever characters it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def every(df: DataFrame) -> list[Column]:
    return [named(c) for c in df.columns]

"""Tables with everything that may be wrong with them."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG = " ".join(f"word{i % 977} filler{i % 13}" for i in range(30_000))
#: Columns whose names the operators use inside.
CLASH = ("mark", "row", "salt", "start", "fp", "size", "lines", "score", "keep_id", "count", "h", "at", "place", "a.b", "label")

SCHEMA = T.StructType().add("doc_id", T.LongType()).add("text", T.StringType()).add("lang", T.StringType()).add("source", T.StringType()).add("n_chars", T.LongType())


def rows():
    texts = [None, "", " \n\t ", "one", "two words", "Same Text here, twice over and so on.", "same text HERE, twice over and so on.", LONG, LONG + " end",
             "A line of text that has enough words.\nAnother line of text with enough words.", "A line of text that has enough words.\nsomething else entirely here now.",
             "mail a@b.co or +1 (269) 555-3296 or 4111 1111 1111 1111 or 1.2.3.4", "É é ß İ ı 漢字 😀   x", "> quoted\nplain", "<p>html</p>", "﻿​"]
    out = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    out += [out[5], out[5], out[0], (None, "no id here at all", None, None, None), (None, None, None, None, None), (7, "another text, same id", "en", None, 3)]
    return out


def messy(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH])


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

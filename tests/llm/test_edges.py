"""Every operator on tables with nulls, empty and long texts, repeats, clashing columns, and none."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from notegraph.llm import chat, decontaminate, exact_dedup, html_extraction, line_dedup, mixing, pii, quality, simhash_dedup, toxicity
from tests.llm.messy import empty, messy, rows


@pytest.fixture(scope="module")
def tables(spark):
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(16)] + [(None, 1, 1), (3, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "Same text here, twice over and so on."), (2, None), (None, ""), (1, "Same text here, twice over and so on.")], "item_id long, text string")
    return {"labels": labels, "benchmark": benchmark}


OPERATORS = {
    "toxicity": (lambda d, t: toxicity.toxicity(d, t["labels"]), True),
    "quality": (lambda d, t: quality.quality(d, t["labels"]), True),
    "leaks": (lambda d, t: decontaminate.leaks(d, t["benchmark"]), False),
    "near": (lambda d, t: simhash_dedup.near_dedup(d), True),
    "exact": (lambda d, t: exact_dedup.exact_dedup(d), True),
    "mix": (lambda d, t: mixing.mix(d), True),
    "lines": (lambda d, t: line_dedup.dedup_lines(d), True),
    "pii": (lambda d, t: pii.personal_data(d), True),
    "html": (lambda d, t: html_extraction.extract(d.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("url"), F.col("text").alias("html"), "n_chars")), True),
    "chat": (lambda d, t: chat.conversations(d.select(F.col("doc_id").alias("conv_id"), F.col("n_chars").alias("turn"), F.col("lang").alias("role"), "text", F.lit(1).alias("path"))), True),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_messy(spark, tables, name):
    run, each = OPERATORS[name]
    got = run(messy(spark), tables).collect()
    if each:
        assert len(got) == len(rows())
    else:
        assert got


@pytest.mark.parametrize("name", OPERATORS)
def test_empty(spark, tables, name):
    assert OPERATORS[name][0](empty(spark), tables).count() == 0


@pytest.mark.parametrize("name", ["toxicity", "quality"])
def test_without_labels(spark, tables, name):
    none = {"labels": tables["labels"].limit(0)}
    got = OPERATORS[name][0](messy(spark), none).collect()
    assert len({r.score for r in got}) == 1 and 0 <= got[0].score <= 1


def test_without_benchmark(spark, tables):
    assert decontaminate.leaks(messy(spark), tables["benchmark"].limit(0)).count() == 0


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
@pytest.mark.parametrize("make", [messy, empty])
def test_stages(spark, tables, tmp_path, k, make):
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    docs = make(spark)
    got = corpus_pipeline.STAGES[k][1](spark, docs, str(tmp_path))
    if k < len(corpus_pipeline.STAGES) - 1:
        assert got.columns == docs.columns
    n = got.count()
    assert n <= docs.count()
    if make is messy and k:
        assert n > 8


def test_rows_without_identifier_stay(spark):
    """Clean rows with a null doc_id pass the filtering stages; equal texts among them stay once."""
    docs = messy(spark)
    for stage in (exact_dedup.unique, simhash_dedup.unique):
        assert stage(docs).where("doc_id IS NULL AND text IS NOT NULL").count() == 1


def test_sweep(spark):
    from notegraph.llm import common

    made = common.durable(spark.range(3))
    assert made.count() == 3
    common.sweep(spark)
    with pytest.raises(Exception, match="(?i)not.*exist|no such|FAILED_READ"):
        spark.read.parquet(made.inputFiles()[0])

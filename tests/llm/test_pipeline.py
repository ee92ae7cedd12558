import corpus_pipeline
from notegraph.llm import queries
from notegraph.llm.common import table

DATA = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "decontamination", "mixing"]
    docs = table(spark, DATA, "documents")
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        sizes.append(len(rows))
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > sizes[0] / 2
    texts = [r.text.lower() for r in docs.collect()]
    assert len(texts) == len(set(texts))
    got = corpus_pipeline.run(spark, DATA).collect()
    assert len(got) == sizes[-1] and {"doc_id", "size", "target", "taken"} <= set(got[0].asDict())


def test_every_operator_is_registered():
    names = queries.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 11)) and "pipeline" in names

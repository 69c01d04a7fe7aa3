import corpus_pipeline
from quarry.llm import mixing


def test_weights_are_of_whole_texts(spark):
    rows = [(1, "a" * 600 + "#" * 1400), (2, "#" * 600 + "a" * 1400), (3, "a b" * 5), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.w for r in df.select("doc_id", mixing.quality(mixing.text_of(df)).alias("w")).collect()}
    assert got == {1: 0.3, 2: 0.7, 3: 1.0, 4: 0.1}


def test_pipeline_takes_documents_by_whole_texts(spark):
    """All start clean; every other one is junk after that."""
    text = lambda i: "good words " * 50 + ("good words " if i % 2 else "#### %%%% ") * 200
    rows = [(i, text(i), "en", "a" if i < 900 else "b", 0) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.mixed(spark, docs, "").where("source = 'a'").groupBy("doc_id").count().collect()
    assert sum(g["count"] for g in got if g.doc_id % 2) > 1.2 * sum(g["count"] for g in got if not g.doc_id % 2)

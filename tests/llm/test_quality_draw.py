import random

import pytest

from quarry.llm import quality


def texts(n=1200, seed=4):
    r = random.Random(seed)
    words = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 9))) for _ in range(300)]
    return [" ".join(r.choice(words) + ("***$$$" if i % 4 == 0 else "") for _ in range(50)) for i in range(n)]


@pytest.mark.parametrize("ids", [[None], [7], [7, 8], [None, 7, 8]])
def test_ids_that_are_null_or_repeat(spark, ids):
    """More rows than the sample's bound, with ids of one hash or few: junk still goes, clean texts still stay."""
    rows = [(ids[i % len(ids)], t, i % 4) for i, t in enumerate(texts())]
    got = quality.classify(spark.createDataFrame(rows, "doc_id long, text string, kind int"), sample=50).groupBy("kind").agg({"accepted": "max", "quality": "min"}).collect()
    assert {x["kind"]: x["max(accepted)"] for x in got} == {0: False, 1: True, 2: True, 3: True}
    assert min(x["min(quality)"] for x in got if x["kind"]) > 0.5


def test_rows_that_are_all_alike_and_scorers_that_are_not_fitted(spark):
    docs = spark.createDataFrame([(1, "some plain words of a text that says so")] * 400, "doc_id long, text string")
    assert quality.train(docs, sample=2) is not None
    assert not any(x.accepted or x.quality for x in quality.score(docs, None).collect())
    assert quality.train(docs.selectExpr("doc_id", "'  ' AS text")) is None


def test_pipeline_stage_with_repeated_ids(spark):
    from corpus_pipeline import good_documents

    rows = [(i % 2 or None, t, "en", "s", i % 4) for i, t in enumerate(texts(400))]
    left = good_documents(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "").collect()
    assert sorted(x.n_chars for x in left) == [k for k in (1, 2, 3) for _ in range(100)]

"""Columns of a caller that are named as those that an operator makes on its way: they stay, or are replaced where the operator says so."""

from quarry.llm import exact_dedup, jaccard_join, quality
from quarry.llm.sentencepiece_codec import decode, encode

WORDS = "the quick brown fox jumps over the lazy dog and runs away from all of them"
MADE = ("k_text", "k_text_", "k_id", "k_sha", "rid", "n_bytes", "name", "node", "mark", "comp", "token", "part", "bits", "n", "at", "x", "spot", "code", "piece_ids", "decoded", "chunk", "row")


def clashing(spark):
    rows = [(1, WORDS), (2, WORDS), (2, WORDS), (3, WORDS + " x"), (4, None), (5, "other words")]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *[f"'{c}' AS {c}" for c in MADE])


def test_without_copies(spark):
    got = exact_dedup.without_copies(clashing(spark))
    assert got.columns == clashing(spark).columns
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == [1, 3, 4, 5] and all(r[c] == c for r in rows for c in MADE)


def test_one_of_each(spark):
    got = jaccard_join.one_of_each(clashing(spark))
    assert got.columns == clashing(spark).columns
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == [1, 4, 5] and all(r[c] == c for r in rows for c in MADE)


def test_score(spark):
    docs = clashing(spark).selectExpr("*", "'q' AS quality", "'a' AS accepted")
    got = quality.score(docs, quality.train(docs))
    rows = got.collect()
    assert len(rows) == 6 and all(isinstance(r.quality, float) and r.accepted in (True, False) and all(r[c] == c for c in MADE) for r in rows)


def test_encode(spark):
    got = decode(encode(clashing(spark))).collect()
    assert sorted((r.doc_id, r.decoded or "") for r in got) == sorted((d, t or "") for d, t in [(1, WORDS), (2, WORDS), (2, WORDS), (3, WORDS + " x"), (4, None), (5, "other words")])

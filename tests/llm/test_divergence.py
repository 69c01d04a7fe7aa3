import random

import pytest

from quarry.llm import divergence


def corpus(seed=5, sources=9):
    r = random.Random(seed)
    words = ["The", "the", "élan", "b", "zz9a", "x-y", "ÄÖ", "don't"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)]
    rows = []
    for _ in range(250):
        s = r.randrange(sources)
        rows.append((" ".join(r.choice(words[s:] if r.random() < 0.7 else words[: 8 + s]) for _ in range(r.choice([0, 1, 5, 30]))), r.choice(["en", "en", "de", None]), None if s == 3 else "s" * s))
    return rows + [(None, "en", "nothing"), ("a b c", "xx", "only"), ("a b c", "xx", "other"), ("", None, None), ("d e f", "yy", None)]


@pytest.mark.parametrize("block", [64, 4])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "PAIRS", 50)
    monkeypatch.setattr(divergence, "HELD", 100)
    rows = corpus()
    docs = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 AS n", "2 AS p", "'t' AS term", "3 AS value", "4 AS rank", "5 AS doc_id")
    for least, top in ((3, 200), (2, 5), (100, 9)):
        got = [tuple(x) for x in divergence.divergence(docs, least, top).collect()]
        assert sorted(got) == sorted(divergence.brute_force(rows, least, top))
    assert divergence.divergence(docs.where("lang = '?'")).count() == 0


def test_rounds_meet_no_more_than_they_need(spark, monkeypatch):
    """Buckets whose bound is below the last term kept stay unmet, and ties at that value don't."""
    monkeypatch.setattr(divergence, "WIDER", 2)
    rows = [(f"t{chr(97 + i % 26)}{chr(97 + i // 26)} " * (1 + i // 20), "en", "a" if k < 3 else "b") for i in range(200) for k in range(3 + i % 3)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    for top in (1, 7, 30):
        got = sorted(tuple(x) for x in divergence.strongest_terms(divergence.Corpus(docs, 3), top).collect())
        assert got == sorted((lang, s, item, value, rank) for lang, s, part, item, value, rank in divergence.brute_force(rows, 3, top) if part == "term")

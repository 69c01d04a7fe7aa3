import random

from quarry.operators import intervals
from quarry.plans.queries import QUERIES


def drawn(seed: int, n: int) -> list[tuple]:
    """Spans of one key with most of them and of many others, from empty ones to one around all, some before zero."""
    r = random.Random(seed)
    widths = (-1, 0, 1, 5, 40, 300, 20_000, 5_000_000)
    rows = [(r.choice(["hot"] * 5 + [f"k{i}" for i in range(30)]), i, r.randrange(-3000, 30_000), r.choice(widths)) for i in range(n)]
    return [(k, i, s, s + w) for k, i, s, w in rows]


def test_spans_of_all_widths_hold_their_points_once(spark):
    for seed, n in ((1, 700), (2, 3), (3, 0)):
        rows = drawn(seed, n)
        spans = spark.createDataFrame(rows, "k string, span long, s int, e int")
        points = spark.createDataFrame([(k, i, s, max(s, e)) for k, i, s, e in drawn(seed + 10, n)], "k string, point long, ps int, pe int")
        got = sorted((r.k, r.point, r.span) for r in intervals.enclosing(points, spans, "k", "point", "span").collect())
        assert got == sorted((p.k, p.point, i) for p in points.collect() for k, i, s, e in rows if k == p.k and s <= p.ps and p.pe <= e)


def test_parents_of_spans_with_equal_ends(spark):
    rows = [("a", 1, 0, 9), ("a", 2, 0, 9), ("a", 3, 2, 5), ("b", 4, 2, 5), ("a", 5, 2, 50), ("a", 6, 20, 10_000_000), ("a", 7, 30, 31)]
    df = spark.createDataFrame(rows, "k string, i long, s long, e long")
    assert sorted((r.i, r.parent_id) for r in intervals.parents(df, "k", "i").collect()) == [(1, None), (2, 1), (3, 2), (4, None), (5, None), (6, None), (7, 6)]


def test_points_are_dealt_once(spark):
    """A point is one row of the exchange, a span as many as it has cells: two on average."""
    spans = spark.range(4000).selectExpr("id % 40 AS k", "id AS span", "id AS s", "id + id * 37 % 900 AS e")
    points = spans.selectExpr("k", "span AS point", "s AS ps", "s AS pe")
    df = intervals.enclosing(points, spans, "k", "point", "span")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1
    assert df.count() == sum(1 for i in range(4000) for j in range(i % 40, i + 1, 40) if i <= j + j * 37 % 900)


def test_chains_compute_their_spans_once(spark):
    plan = QUERIES["scope_chain"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "events.parquet" not in plan and "user_id" not in plan

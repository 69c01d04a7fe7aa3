import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import flow, intervals, prefix


def rows(n=3000, keys=4, seed=1):
    r = random.Random(seed)
    return [(None if r.random() < 0.05 else r.choice([0] * 9 + list(range(keys))), r.randint(0, 500), r.choice([None, *range(50)]), i) for i in range(n)]


def test_running_aggregates_are_those_of_windows(spark):
    df = spark.createDataFrame(rows(), "k int, o int, v int, id int")
    w = Window.partitionBy("k").orderBy("o", F.desc("id")).rowsBetween(Window.unboundedPreceding, -1)
    for kind, of in (("max", F.max), ("min", F.min), ("sum", F.sum), ("count", F.count)):
        got = prefix.running(df, ["k"], ["o", F.desc("id")], "x", kind, F.col("v"), blocks=7).select("id", F.coalesce("x", F.lit(-1)).alias("x")).collect()
        zero = F.lit(0 if kind in ("sum", "count") else -1)
        assert sorted(got) == sorted(df.select("id", F.coalesce(of("v").over(w), zero).alias("x")).collect())
    assert prefix.running(df.where("id < 0"), ["k"], ["o"], "x", "max", F.col("v")).count() == 0


def test_places_of_all_rows(spark):
    df = spark.createDataFrame(rows(), "k int, o int, v int, id int")
    got = [x.place for x in prefix.ranked(df, ["o", "id"], blocks=5).orderBy("o", "id").collect()]
    assert got == list(range(1, 3001))


def test_one_key_with_all_rows_is_many_tasks(spark):
    """The blocks of a hot key are of like size, and so what a task holds."""
    df = spark.range(20_000).select(F.lit(1).alias("k"), (F.col("id") * 7 % 20_000).alias("o"))
    sizes = [x["count"] for x in prefix.blocked(df, ["k"], ["o"], 8).groupBy("_block").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 20_000 / 8
    spans = df.select("k", F.col("o").alias("s"), (F.col("o") + F.col("o") % 11).alias("e"))
    before = Window.partitionBy("k").orderBy("s", F.desc("e")).rowsBetween(Window.unboundedPreceding, -1)
    want = spans.withColumn("r", F.max("e").over(before)).where("r IS NULL OR e > r").drop("r")
    assert sorted(intervals.maximal(spans, "k").collect()) == sorted(want.collect())


def test_steps_that_repeat_across_blocks(spark):
    r = random.Random(2)
    said = [(k, i, r.choice("ab"), None if r.random() < 0.2 else 1) for k in "xy" for i in range(400)]
    df = spark.createDataFrame(said, "k string, n int, label string, line int")
    got = sorted((x.k, x.n) for x in flow.without_repeats(df, "k", ["n"], ["label", "line"]).collect())
    w = Window.partitionBy("k").orderBy("n")
    want = df.withColumn("b", F.lag(F.struct("label", "line")).over(w)).where(F.col("b").isNull() | (F.col("b") != F.struct("label", "line")))
    assert got == sorted((x.k, x.n) for x in want.collect())

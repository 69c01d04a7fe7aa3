from quarry.llm import jaccard_join


def part(text):
    return jaccard_join.digest(jaccard_join.shingles(text)) % jaccard_join.PARTS


def test_text_alone_in_a_part_of_its_frequent_shingles_keeps_its_link(spark):
    """A hot text and one near copy, all of whose common prefix shingles are frequent: one of the two in the first part, the other not."""
    for hot_first in (True, False):
        words = [f"{hot_first}{i}" for i in range(40)]
        variants = [" ".join([*words[:-1], f"x{i}"]) for i in range(2000)]
        first, other = next(t for t in variants if part(t) == 0), next(t for t in variants if part(t))
        hot, near = (first, other) if hot_first else (other, first)
        rows = [(i, hot) for i in range(60)] + [(100, near)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        # nothing but frequent shingles can bring the two together
        rare = jaccard_join._rare(jaccard_join._profile(df, jaccard_join.WORDS))
        shared = set(jaccard_join.shingles(hot)) & set(jaccard_join.shingles(near))
        assert all(not rare[int(t) & (jaccard_join.COUNTERS - 1)] for t in shared)
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(df).collect()}
        assert got == jaccard_join.brute_force(rows) and got[100][1] == 0


def test_copies_meet_as_one_row_a_task(spark):
    """No exchange by a text's name moves rows of copies that their tasks haven't merged: with 2,000 copies in 8 tasks, 8 at most."""
    from pyspark.sql import functions as F

    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a b c d e f g").otherwise(F.concat_ws(" ", *[F.col("id") * k for k in range(1, 8)])).alias("text")).repartition(8)
    profile = jaccard_join.stored(jaccard_join._profile(rows, jaccard_join.WORDS)).where("n > 0")
    nodes = jaccard_join.stored(profile.select("node").distinct())
    plan = profile.groupBy("node").agg(F.max("doc_id").alias("doc_id")).join(nodes, "node")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")
    sets = jaccard_join._sets(rows, profile, nodes, jaccard_join.WORDS)
    assert sets.count() == 2001


def test_counters_are_summed_by_trees_and_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FAN", 2)
    monkeypatch.setattr(jaccard_join, "COUNTED", 1)
    docs = spark.createDataFrame([(i, f"a b c d e {i}") for i in range(3000)], "doc_id long, text string").repartition(9)
    size = jaccard_join.counters(3_000_000)
    assert size == jaccard_join.MOST_COUNTERS and jaccard_join.counters(5) == jaccard_join.COUNTERS
    rare = jaccard_join._rare(jaccard_join.stored(jaccard_join._profile(docs, jaccard_join.WORDS, size)))
    shared = set(jaccard_join.shingles("a b c d e 1")) & set(jaccard_join.shingles("a b c d e 2"))
    assert len(rare) == size and [rare[int(t) & (size - 1)] for t in shared] == [False] and rare.sum() >= size - 2
    assert jaccard_join._rare(jaccard_join._profile(docs.where("doc_id < 0"), jaccard_join.WORDS)).all()

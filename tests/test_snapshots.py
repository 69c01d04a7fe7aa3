import random

from quarry.operators import dataflow, snapshots


def tree(spark, files):
    return snapshots.Tree(spark.createDataFrame(sorted(files.items()), "path string, content_hash string"))


def test_changes_are_found_and_equal_folders_are_not_compared(spark):
    r = random.Random(3)
    old = {f"a{i % 10}/b{i % 7}/c{i % 5}/f{i}": str(r.random()) for i in range(3000)} | {"top": "1", "x": "1"}
    new = dict(old)
    new["a1/b1/c1/f1"] = "edited"
    del new["a2/b2/c2/f2"]
    new["a3/new/deep/er/f"] = "1"
    del new["x"]
    new["x/y"] = "1"
    found, compared = snapshots.changes(tree(spark, old), tree(spark, new))
    assert sorted(map(tuple, found.collect())) == [("a1/b1/c1/f1", "edited"), ("a2/b2/c2/f2", "removed"), ("a3/new/deep/er/f", "added"), ("x", "removed"), ("x/y", "added")]
    assert sum(compared) < len(old) / 10
    same, compared = snapshots.changes(tree(spark, old), tree(spark, old))
    assert same.count() == 0 and compared == [12]


def test_common_names_stay_linear(spark):
    """One name that 2,000 files declare and 20,000 modules import: a row a module, no pairs."""
    declared = spark.range(2000).selectExpr("concat('f', id) AS file", "'Unit' AS name").union(spark.createDataFrame([("own", "p7.Unit")], "file string, name string"))
    imported = spark.range(20_000).selectExpr("concat('org/p', id, '.Unit') AS module")
    got = dataflow.by_longest_suffix(imported, declared)
    rows = {(x.suffix, x["files"], x.file): x.n for x in got.groupBy("suffix", "files", "file").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert rows == {("Unit", 2000, None): 19_999, ("p7.Unit", 1, "own"): 1}

"""What changed between two snapshots of a table of files, by trees of digests: equal folders are never joined."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.sources.store import materialised

ROOT = ""


class Tree:
    """Digests of files (path, content_hash) and of all folders above them, a table for each depth.

    A folder's digest is made of sums over its entries' digests (128 bits), so it is aggregated where the entries are, however many
    a folder has. Building reads each level once: levels shrink fast.
    """

    def __init__(self, files: DataFrame):
        parts = F.split("path", "/")
        rows = files.select("path", F.size(parts).alias("depth"), F.lit(True).alias("file"), F.col("content_hash").alias("digest"))
        rows = materialised(rows)
        self.depth = rows.agg(F.max("depth")).first()[0] or 0
        self.levels: dict[int, DataFrame] = {}
        folders = None
        for d in range(self.depth, 0, -1):
            level = rows.where(F.col("depth") == d).select("path", "file", "digest")
            level = level if folders is None else level.unionByName(folders)
            up = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(ROOT)
            self.levels[d] = materialised(level.withColumn("parent", up))
            folders = self._above(self.levels[d])
        self.root = folders

    @staticmethod
    def _above(level: DataFrame) -> DataFrame:
        sums = [F.sum(F.xxhash64("path", "file", "digest", F.lit(k)).cast("decimal(20,0)")) for k in range(2)]
        return level.groupBy("parent").agg(F.concat_ws(":", *[s.cast("string") for s in sums], F.count("*").cast("string")).alias("digest")).select(F.col("parent").alias("path"), F.lit(False).alias("file"), "digest")


def changes(old: Tree, new: Tree) -> tuple[DataFrame, list[int]]:
    """path, change (added, removed, edited) between two snapshots, and how many entries were compared at each depth: those of
    folders that differ, from the top down. A path that was a file and is a folder is removed, and what is below it added."""
    spark = (old.levels or new.levels or {0: None}).get(1)
    if spark is None:
        raise ValueError("both snapshots are empty")
    session, found, compared = spark.sparkSession, [], []
    front = session.createDataFrame([(ROOT,)], "parent string")
    for d in range(1, max(old.depth, new.depth) + 1):
        sides = []
        for tree, name in ((old, "old"), (new, "new")):
            level = tree.levels.get(d)
            entries = level.join(front, "parent", "left_semi") if level is not None else front.where("false").select(F.lit("").alias("path"), F.lit(True).alias("file"), F.lit("").alias("digest"), "parent")
            sides.append(entries.select("path", "file", F.col("digest").alias(name)))
        met = materialised(sides[0].join(sides[1], ["path", "file"], "full_outer"))
        compared.append(met.count())
        differ = met.where(~F.col("old").eqNullSafe(F.col("new")))
        what = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("edited")
        found.append(differ.where("file").select("path", what.alias("change")))
        front = differ.where("NOT file").select(F.col("path").alias("parent")).distinct()
        if front.isEmpty():
            break
    return reduce(DataFrame.unionByName, found), compared

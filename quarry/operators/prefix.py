"""Running aggregates over ordered rows, however many one key has: a blocked scan.

Rows are dealt to blocks by ranges of (keys, order), so a hot key lies in many blocks. Each block aggregates its own rows; what
lies before a block is the exclusive scan of the totals of the keys that cross its border, at most two a block; a row adds the
two. No task holds more than a block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.store import materialised

FUNCTIONS = {"max": F.max, "min": F.min, "sum": F.sum, "count": F.count}


def blocked(df: DataFrame, keys: list[str], order: list, blocks: int | None = None) -> DataFrame:
    """df with _block and _row: range partitions by keys and order (ties by a digest of the row), written once."""
    n = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(k) for k in keys], *[F.col(o) if isinstance(o, str) else o for o in order], F.xxhash64(*df.columns)]
    dealt = df.repartitionByRange(n, *by).sortWithinPartitions(*by)
    return materialised(dealt.withColumn("_block", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))


def running(df: DataFrame, keys: list[str], order: list, name: str, kind: str, value: Column, blocks: int | None = None) -> DataFrame:
    """df with `name`: max, min, sum or count of `value` over the rows of the same keys before this one; null (count and sum: 0)
    where there are none."""
    of, rows = FUNCTIONS[kind], blocked(df.withColumn("_v", value), keys, order, blocks)
    local = of("_v").over(Window.partitionBy("_block", *keys).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_local", local)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.lit(True))
    if keys:
        # keys that may cross a border: the first and the last of each block
        key = F.struct(*keys)
        ends = rows.groupBy("_block").agg(F.min_by(key, "_row").alias("a"), F.max_by(key, "_row").alias("b"))
        edge = ends.select(F.explode(F.array("a", "b")).alias("k")).distinct().select(*[F.col("k")[k].alias(f"_k{i}") for i, k in enumerate(keys)])
        part = rows.join(F.broadcast(edge), same, "left_semi")
    else:
        part = rows
    totals = part.groupBy("_block", *keys).agg(of("_v").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = F.sum("_t") if kind == "count" else of("_t")
    carried = totals.withColumn("_carry", carry.over(before)).select(F.col("_block").alias("_at"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_carry")
    out = rows.join(F.broadcast(carried), (F.col("_block") == F.col("_at")) & same, "left").select(*rows.columns, "_carry")
    if kind in ("sum", "count"):
        both = F.coalesce("_local", F.lit(0)) + F.coalesce("_carry", F.lit(0))
    else:
        both = (F.greatest if kind == "max" else F.least)("_local", "_carry")
    return out.withColumn(name, both).drop("_block", "_row", "_v", "_local", "_carry")


def ranked(df: DataFrame, order: list, name: str = "place", blocks: int | None = None) -> DataFrame:
    """df with each row's place (from 1) in the order of all rows: counts of range partitions are summed, rows are not gathered."""
    return running(df, [], order, "_before", "count", F.lit(1), blocks).withColumn(name, F.col("_before") + 1).drop("_before")

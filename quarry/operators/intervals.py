"""Interval joins and windows. A span lies in cells of a grid as wide as spans are on average, a point in one, so that what holds a point
is found by equality, and points and spans are dealt once: a span lies in two cells on average, and meets points as far away as spans
are wide. Keys with many spans have a grid of their own; spans much wider than their grid's cells have a coarser one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.sources.store import materialised

from .prefix import running


def cells(spans: DataFrame, s: str = "s", e: str = "e", levels: int = 40) -> DataFrame:
    """spans with level and cell: a row for each of the dyadic cells (cell << level wide) that make up the closed span; at most two
    a level. An empty span has none."""
    grid = f"""filter(flatten(transform(sequence(0, {levels - 1}), l -> transform(
        filter(array(
            named_struct('level', l, 'cell', shiftright({s} + shiftleft(1L, l) - 1, l), 'on', shiftright({s} + shiftleft(1L, l) - 1, l) % 2 != 0),
            named_struct('level', l, 'cell', shiftright({e} + 1, l) - 1, 'on', shiftright({e} + 1, l) % 2 != 0)
        ), c -> c.on AND shiftright({s} + shiftleft(1L, l) - 1, l) < shiftright({e} + 1, l)), c -> struct(c.level, c.cell)))), c -> c IS NOT NULL)"""
    return spans.withColumn("_c", F.explode(F.expr(grid))).withColumns({"level": F.col("_c.level"), "cell": F.col("_c.cell")}).drop("_c")


#: Cells of a span, at most; wider ones wait for a coarser grid. Keys that have a grid of their own, at most.
CELLS, OWN = 64, 1000


def enclosing(points: DataFrame, spans: DataFrame, key: str, point_id: str, span_id: str) -> DataFrame:
    """Pairs of point_id and span_id of one key where the span (s, e) holds the point's (ps, pe). Ends are integers."""
    at = points.withColumn("_p", F.col("ps").cast("long"))
    rest = spans.withColumns({"s": F.col("s").cast("long"), "e": F.col("e").cast("long")}).where("s <= e")
    out = None
    while True:
        each = materialised(rest.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.expr("double(e) - s + 1")).alias("w"), F.max(F.expr("double(e) - s + 1")).alias("widest")))  # a row a key
        level = lambda w, n: F.greatest(F.lit(0), F.ceil(F.log2(w / n))).cast("int")
        n = each.agg(F.sum("n")).first()[0] or 0
        many = F.col("n") > n // OWN
        common = each.where(~many).agg(level(F.sum("w"), F.sum("n")).alias("level"), F.max("widest").alias("widest")).first()
        own = each.where(many).select(F.col(key).alias("_k"), level(F.col("w"), F.col("n")).alias("level"), "widest")
        rare = F.lit(common["level"] or 0)
        found = own.agg(F.count("*"), F.max(F.col("widest") / F.pow(F.lit(2.0), F.col("level")))).first()
        graded = (lambda df: df.join(F.broadcast(own.select("_k", "level")), F.col(key) == F.col("_k"), "left").withColumn("_l", F.coalesce("level", rare)).drop("_k", "level")) if found[0] else (lambda df: df.withColumn("_l", rare))
        wide = max(found[1] or 0, (common["widest"] or 0) / 2.0 ** (common["level"] or 0)) > CELLS
        held = graded(rest).withColumn("_n", F.expr("shiftright(e, _l) - shiftright(s, _l)"))
        fits = held.where(F.col("_n") <= CELLS).withColumn("_cell", F.explode(F.expr("sequence(shiftright(s, _l), shiftright(e, _l))"))).drop("_l", "_n")
        met = graded(at).withColumn("_cell", F.expr("shiftright(_p, _l)")).drop("_l").join(fits, [key, "_cell"]).where("s <= _p AND _p <= e AND pe <= e").drop("_cell", "_p")
        out = met if out is None else out.unionByName(met)
        if not wide:
            return out
        rest = held.where(F.col("_n") > CELLS).drop("_l", "_n")


def innermost(points: DataFrame, spans: DataFrame, key: str, point_id: str, span_id: str) -> DataFrame:
    """The smallest span around each point, ties to the later: key, point_id, span_id, s, e. Combined before the shuffle."""
    best = enclosing(points, spans, key, point_id, span_id).groupBy(key, point_id).agg(F.min(F.struct((F.col("e") - F.col("s")).alias("w"), (-F.col(span_id)).alias("o"), "s", "e")).alias("b"))
    return best.select(key, point_id, (-F.col("b.o")).alias(span_id), F.col("b.s").alias("s"), F.col("b.e").alias("e"))


def nearest(spans: DataFrame, key: str, span_id: str) -> DataFrame:
    """key, span_id, parent_id of each span that one before it contains: the nearest such."""
    points = spans.select(key, F.col(span_id).alias("child_id"), F.col("s").alias("ps"), F.col("e").alias("pe"))
    up = enclosing(points, spans.select(key, span_id, "s", "e"), key, "child_id", span_id).where(F.col(span_id) < F.col("child_id"))
    return up.groupBy(key, F.col("child_id")).agg(F.max(span_id).alias("parent_id")).withColumnRenamed("child_id", span_id)


def parents(spans: DataFrame, key: str, span_id: str) -> DataFrame:
    """Each span with the nearest span before it that contains it, null at the top."""
    return spans.join(nearest(spans, key, span_id), [key, span_id], "left")


def ancestors(edges: DataFrame, depth: int) -> DataFrame:
    """child, ancestor, distance up to depth; edges: child, parent, written once. Unrolled, so that plans stay bounded."""
    edges = materialised(edges)
    level = edges.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("distance"))
    out = level
    for d in range(2, depth + 1):
        level = level.alias("l").join(edges.alias("e"), F.col("l.ancestor") == F.col("e.child")).select(F.col("l.child"), F.col("e.parent").alias("ancestor"), F.lit(d).alias("distance"))
        out = out.unionByName(level)
    return out


def maximal(spans: DataFrame, key: str) -> DataFrame:
    """Spans that no earlier or wider one covers: by start, then end falling, those that end beyond all before them. A key's spans
    are scanned by blocks, so one with all of them is no single task."""
    reach = running(spans, [key], ["s", F.desc("e")], "_reach", "max", F.col("e"))
    return reach.where(F.col("_reach").isNull() | (F.col("e") > F.col("_reach"))).drop("_reach")

"""Data-flow and linking operators over relations: bounded reachability, witnesses, stitching, import resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .findings import one_each
from .prefix import running


def reach(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """node, hop: the fewest edges (src, dst) from start (node), `hops` at most. Semi-naive: each round joins only what is new,
    and a node that was reached before is dropped."""
    seen = start.select("node").distinct().withColumn("hop", F.lit(0))
    front = seen
    for h in range(1, hops + 1):
        step = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct().withColumn("hop", F.lit(h))
        front = step.join(seen.select("node"), "node", "left_anti")
        seen = seen.unionByName(front)
    return seen


def earliest(facts: DataFrame, keys: list[str], by: str, carry: list[str]) -> DataFrame:
    """Per key the fact with the smallest `by`, ties by the carried columns; combined before the shuffle."""
    best = facts.groupBy(*keys).agg(F.min(F.struct(by, *carry)).alias("w"))
    return best.select(*keys, *[F.col("w")[c].alias(c) for c in [by, *carry]])


def first_hit(imports: DataFrame, files: DataFrame, endings: list[str], index_names: list[str]) -> DataFrame:
    """imports (import_id, target) with the file each resolves to: the path as it is, then with each ending, then as a folder
    with each index file; the first that exists."""
    return first_of(imports, files, ways(endings, index_names))


def ways(endings: list[str], index_names: list[str]) -> Column:
    """What a target may mean, the likeliest first."""
    return F.array(F.col("target"), *[F.concat("target", F.lit("." + e)) for e in endings], *[F.concat("target", F.lit("/" + n)) for n in index_names])


def first_of(imports: DataFrame, files: DataFrame, options: Column) -> DataFrame:
    """import_id, target, path, nth: the first of each import's options that is a file."""
    tried = imports.select("import_id", "target", F.posexplode(options).alias("nth", "path"))
    return one_each(tried.join(files.select("path").distinct(), "path"), ["import_id"], ["nth"])


def hops(exports: DataFrame, depth: int = 4) -> DataFrame:
    """start, name, target, hop: follows re-exports (src, name, dst, other) up to depth; the last hop of a start wins."""
    level = exports.select(F.col("src").alias("start"), "name", F.col("dst").alias("target"), F.col("other").alias("wanted"), F.lit(1).alias("hop"))
    out = level
    for h in range(2, depth + 1):
        e = exports.select(F.col("src").alias("e_src"), F.col("name").alias("e_name"), F.col("dst").alias("e_dst"), F.col("other").alias("e_other"))
        level = level.join(e, (level["target"] == e["e_src"]) & (level["wanted"] == e["e_name"])).select("start", "name", F.col("e_dst").alias("target"), F.col("e_other").alias("wanted"), F.lit(h).alias("hop"))
        out = out.unionByName(level)
    return one_each(out, ["start", "name"], [F.desc("hop"), "target"]).select("start", "name", "target", "hop")


def set_hash(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, digest, count of the distinct values (hex digits) of each key: values are sorted and digested by their first two
    digits, then the digests in order, so that a key with very many values is no single task."""
    part = F.substring(value, 1, 2)
    parts = rows.select(key, value).distinct().groupBy(key, part.alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(value)), "\n"), 256).alias("digest"), F.count("*").alias("n"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "digest"))), lambda p: p["digest"]), "\n")
    return parts.groupBy(key).agg(F.sha2(whole, 256).alias("digest"), F.sum("n").alias("count"))


def visible(uses: DataFrame, writes: DataFrame, ancestors: DataFrame) -> DataFrame:
    """uses (use_id, scope, base, at) joined to the writes (scope, base, written, origin) that they see: those before them in their
    own scope, all in scopes around it (ancestors: child, ancestor); the earliest write of each origin."""
    own = uses.join(writes, ["scope", "base"]).where("written < at").select("use_id", "origin", "written")
    up = uses.join(ancestors, uses["scope"] == ancestors["child"]).select("use_id", F.col("ancestor").alias("scope"), "base")
    return own.unionByName(up.join(writes, ["scope", "base"]).select("use_id", "origin", "written")).groupBy("use_id", "origin").agg(F.min("written").alias("written"))


def nearest_sources(calls: DataFrame, levels: int) -> DataFrame:
    """func, arg, level, call_id: for each parameter that a caller passes a source to, itself or through callers' own parameters,
    the fewest callers and, of those so near, the first call that passes the source. The states of all parameters are relaxed
    backward together, a level a round: a round joins the parameters that the round before settled to the distinct passings of
    parameters, so the work follows the calls, however many sinks ask."""
    passings = calls.where("NOT source AND caller_param IS NOT NULL").select("func", "arg", F.col("caller").alias("of_func"), F.col("caller_param").alias("of_arg")).distinct()
    front = calls.where("source").groupBy("func", "arg").agg(F.min("call_id").alias("call_id")).withColumn("level", F.lit(1))
    known = front
    for level in range(2, levels + 1):
        of = front.select(F.col("func").alias("of_func"), F.col("arg").alias("of_arg"), "call_id")
        met = passings.join(of, ["of_func", "of_arg"]).groupBy("func", "arg").agg(F.min("call_id").alias("call_id")).withColumn("level", F.lit(level))
        front = met.join(known.select("func", "arg"), ["func", "arg"], "left_anti")
        known = known.unionByName(front)
    return known.select("func", "arg", "level", "call_id")


def stitch(sinks: DataFrame, calls: DataFrame, levels: int = 3) -> DataFrame:
    """sink_id, level, call_id: sinks (sink_id, func, param) that a parameter reaches, followed to the callers (call_id, func, arg,
    source, caller, caller_param) that pass a source, or a parameter of their own, up to `levels` callers; the nearest, then the
    first call. All sinks share the states of parameters."""
    states = nearest_sources(calls, levels)
    best = sinks.join(states, (sinks["func"] == states["func"]) & (sinks["param"] == states["arg"])).groupBy("sink_id").agg(F.min(F.struct("level", "call_id")).alias("b"))
    return best.select("sink_id", "b.level", "b.call_id")


def merge_summaries(facts: DataFrame) -> DataFrame:
    """What functions of one name in one file return and do, from facts (file, rule_id, func, origin, param, place): the first source,
    the parameters that are returned, the parameters that reach sinks (origin: source, returned, sink), sorted."""
    of = lambda kind, c: F.when(F.col("origin") == kind, F.col(c))
    return facts.groupBy("file", "rule_id", "func").agg(F.min(of("source", "place")).alias("source"), F.array_sort(F.collect_set(of("returned", "param"))).alias("params"), F.array_sort(F.collect_set(of("sink", "param"))).alias("sinks"))


def minted(calls: DataFrame) -> DataFrame:
    """calls of linked functions (path, rule_id, start) with a number for each as an origin from outside, in their order."""
    return calls.withColumn("external", F.row_number().over(Window.partitionBy("path", "rule_id").orderBy("start")) - 1)


def alias_hop(locals_: DataFrame) -> DataFrame:
    """locals (path, local, target, name) where a target is itself a local of the file: what that one is, one step on."""
    other = locals_.select("path", F.col("local").alias("target"), F.col("target").alias("other"), F.col("name").alias("other_name"))
    return locals_.join(other, ["path", "target"], "left").select("path", "local", F.coalesce("other", "target").alias("target"), F.coalesce("other_name", "name").alias("name"))


def without_repeats(steps: DataFrame, key: str, order: list[str], same: list[str]) -> DataFrame:
    """Drops a step that says the same as the one before it, by blocks of a key's steps."""
    # what a step says, by its place: the greatest of those before it is the one before it
    numbered = running(steps, [key], order, "_before", "count", F.lit(1))
    last = running(numbered, [key], order, "_last", "max", F.struct("_before", F.struct(*same).alias("said")))
    return last.where(F.col("_last").isNull() | (F.col("_last.said") != F.struct(*same))).drop("_before", "_last")


def verdict(reached: Column, stitched: Column, parameter: Column, sanitised: Column) -> Column:
    """Why a sink is or isn't reported; the first that holds."""
    return F.when(reached, "source reaches sink").when(stitched, "caller passes a source").when(parameter, "parameter without a tainted caller").when(sanitised, "sanitised").otherwise("nothing reaches it")

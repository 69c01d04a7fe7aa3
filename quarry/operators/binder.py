"""What names in calls and reads are, as joins: by a file's imports, then by its functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_import(imports: DataFrame) -> DataFrame:
    """The first import of each local name of a file, by module and name: path, first, i_module, i_name."""
    best = imports.groupBy("path", F.col("local").alias("first")).agg(F.min(F.struct("module", "name")).alias("i"))
    return best.select("path", "first", F.col("i.module").alias("i_module"), F.col("i.name").alias("i_name"))


def resolved_names(calls: DataFrame, imports: DataFrame, functions: DataFrame) -> DataFrame:
    """calls of bare names (path, start, name, target) with symbol, module, resolution: an import of that name (external), else a
    function of the file (local), else unresolved. What stands for a whole module resolves no bare name."""
    bare = calls.where(~F.col("target").contains(".")).withColumn("first", F.col("target"))
    named = one_import(imports).where("i_name <> '*'")
    own = functions.select("path", F.col("name").alias("first"), F.lit(True).alias("own")).distinct()
    out = bare.join(named, ["path", "first"], "left").join(own, ["path", "first"], "left")
    kind = F.when(F.col("i_module").isNotNull(), "external").when(F.coalesce("own", F.lit(False)), "local").otherwise("unresolved")
    return out.select("path", "start", "name", "target", F.coalesce("i_name", "name").alias("symbol"), F.col("i_module").alias("module"), kind.alias("resolution"))


def resolved_methods(calls: DataFrame, imports: DataFrame) -> DataFrame:
    """calls of members with symbol, module, resolution: of what an import brings in (external), else of whatever it is (member)."""
    of = calls.where(F.col("target").contains(".")).withColumn("first", F.substring_index("target", ".", 1))
    out = of.join(one_import(imports), ["path", "first"], "left")
    kind = F.when(F.col("i_module").isNotNull(), "external").otherwise("member")
    return out.select("path", "start", "name", "target", F.col("name").alias("symbol"), F.col("i_module").alias("module"), kind.alias("resolution"))


def resolved_calls(calls: DataFrame, imports: DataFrame, functions: DataFrame) -> DataFrame:
    """Calls of bare names and of members together."""
    return resolved_names(calls, imports, functions).unionByName(resolved_methods(calls, imports))


def resolved_reads(reads: DataFrame, imports: DataFrame) -> DataFrame:
    """reads (path, start, target) with base, fields and the module that an import of the base brings in."""
    out = reads.withColumns({"first": F.substring_index("target", ".", 1), "fields": F.slice(F.split("target", r"\."), 2, 3)})
    return out.join(one_import(imports), ["path", "first"], "left").select("path", "start", "target", F.col("first").alias("base"), "fields", F.col("i_module").alias("module"))


def identity_hits(resolved: DataFrame, matchers: DataFrame) -> DataFrame:
    """Resolved calls joined to matchers (matcher_id, name, module, unresolved): equal symbols, then module against module or receiver;
    a matcher without a module takes what is not unresolved, or anything where it says so. Matchers are a few hundred rows."""
    m = F.broadcast(matchers.select("matcher_id", F.col("name").alias("symbol"), F.col("module").alias("want"), "unresolved"))
    receiver = F.regexp_extract("target", r"^(.*)\.[^.]*$", 1)
    by_module = F.coalesce(F.col("module"), receiver) == F.col("want")
    ok = F.when(F.col("want").isNotNull(), by_module).otherwise(F.col("unresolved") | (F.col("resolution") != "unresolved"))
    return resolved.join(m, "symbol").where(ok).select("matcher_id", "path", "start", "target")


def reads_matched(reads: DataFrame, matchers: DataFrame) -> DataFrame:
    """Resolved reads joined to matchers (matcher_id, module, member_of, fields): the module of the base, else its name, and the
    fields a prefix of the read's."""
    m = F.broadcast(matchers.select("matcher_id", F.col("module").alias("want"), "member_of", F.col("fields").alias("wanted")))
    owner = F.when(F.col("want").isNotNull(), F.col("module") == F.col("want")).when(F.col("member_of").isNotNull(), F.col("base") == F.col("member_of")).otherwise(F.lit(True))
    prefix = F.slice("fields", F.lit(1), F.size("wanted")) == F.col("wanted")
    return reads.join(m, F.coalesce(owner, F.lit(False)) & prefix).select("matcher_id", "path", "start", "target")

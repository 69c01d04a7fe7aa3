"""A benchmark of test cases whose files say where the flaw is: cases named by weakness, good and bad functions, findings scored."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.scalars import content_hash

from . import intervals, measures

#: Which rules are meant to find which weakness.
MAPPING = {"CWE-89": ["cs.sql-injection"], "CWE-78": ["cs.cmd-injection"], "CWE-79": ["cs.xss.response-write"], "CWE-22": ["cs.path-traversal"], "CWE-327": ["cs.weak-crypto"], "CWE-328": ["cs.weak-crypto"], "CWE-798": ["cs.hardcoded-secret"]}
BLANK = re.compile(r'//[^\n]*|/\*(?s:.*?)(?:\*/|\Z)|@"(?:""|[^"])*"?|"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])+\'')


def cases(spark: SparkSession, root: str) -> DataFrame:
    """path, cwe, testcase, variant, text, and what a scan asks of files, of the C# files below root that name a weakness."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.cs").load(root)
    files = raw.select(F.col("path"), F.lit("csharp").alias("lang"), F.col("length").alias("size"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"), content_hash(F.col("content")).alias("content_hash"))
    return named(files).where("cwe <> 'CWE-'")


def named(files: DataFrame) -> DataFrame:
    """files with cwe, testcase (the name without a letter after its number) and variant: what a file's name says."""
    base = F.regexp_extract("path", r"([^/]+)$", 1)
    number, letter = F.regexp_extract(base, r"(?i)_(\d+)([a-z]?)\.cs$", 1), F.regexp_extract(base, r"(?i)_(\d+)([a-z]?)\.cs$", 2)
    first = number.rlike("^0*1?$") & (number != "") & (letter == "")
    return files.withColumns({"cwe": F.concat(F.lit("CWE-"), F.regexp_extract(base, r"CWE(\d+)", 1)), "testcase": F.regexp_replace(base, r"(?i)(_\d+)[a-z]?\.cs$", "$1"), "variant": F.when(first, "baseline").otherwise("flow-variant")})


def kind_of(method: Column, owner: Column) -> Column:
    """good or bad by the method's name, else by its class; a name that says both is good."""
    of = lambda c: F.when(F.lower(c).contains("good"), "good").when(F.lower(c).contains("bad"), "bad")
    return F.coalesce(of(F.coalesce(method, F.lit(""))), of(F.coalesce(owner, F.lit(""))))


def stripped(text: str) -> str:
    """Code with comments and strings blanked out, everything at its place."""
    return BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def regions(filed: DataFrame) -> DataFrame:
    """path, region_id, s, e (lines), kind of the functions that are good or bad, by their own name or their class's."""
    flat = filed.select("path", F.explode("facts").alias("f")).select("path", "f.fact", "f.name", "f.start", "f.end", "f.line", "f.end_line")
    types = flat.where("fact = 'type'").select("path", F.col("start").alias("type_id"), F.col("start").alias("s"), F.col("end").alias("e"), F.col("name").alias("owner"))
    functions = flat.where("fact = 'function' AND name IS NOT NULL").select("path", F.col("start").alias("region_id"), F.col("start").alias("ps"), F.col("end").alias("pe"), "name", "line", "end_line")
    around = intervals.innermost(functions, types.drop("owner"), "path", "region_id", "type_id").select("path", "region_id", "type_id")
    out = functions.join(around, ["path", "region_id"], "left").join(types.select("path", "type_id", "owner"), ["path", "type_id"], "left")
    return out.select("path", "region_id", F.col("line").alias("s"), F.col("end_line").alias("e"), kind_of(F.col("name"), F.col("owner")).alias("kind")).where("kind IS NOT NULL")


def score(files: DataFrame, known: DataFrame, findings: DataFrame, mapping: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Tallies by cwe (with the grand total, cwe null) with their metrics, and recall by cwe and variant.

    files: path, cwe, testcase, variant; known: regions; findings: path, rule_id, line. A finding of a rule that is meant for the
    weakness counts for the smallest region around it. Bad regions are scored by test case, however many files it has: one hit is
    enough; good ones each by itself. Weaknesses without a rule are left out.
    """
    spark = files.sparkSession
    meant = spark.createDataFrame([(c, r) for c, rs in (mapping or MAPPING).items() for r in rs], "cwe string, rule_id string")
    scored = files.select("path", "cwe", "testcase", "variant").join(F.broadcast(meant.select("cwe").distinct()), "cwe", "left_semi")
    hits = findings.select("path", "rule_id", "line").join(scored.select("path", "cwe"), "path").join(F.broadcast(meant), ["cwe", "rule_id"], "left_semi").select("path", F.col("line").alias("point_id"), F.col("line").alias("ps"), F.col("line").alias("pe")).distinct()
    struck = intervals.innermost(hits, known, "path", "point_id", "region_id").select("path", "region_id").distinct().withColumn("hit", F.lit(True))
    by_region = known.join(struck, ["path", "region_id"], "left").join(scored, "path").withColumn("hit", F.coalesce("hit", F.lit(False)))
    bad, good = F.col("kind") == "bad", F.col("kind") == "good"
    by_case = by_region.groupBy("cwe", "testcase", "variant").agg(F.bool_or(bad).alias("bad"), F.bool_or(bad & F.col("hit")).alias("struck"), F.count_if(good & F.col("hit")).alias("fp"), F.count_if(good & ~F.col("hit")).alias("tn"))
    tallies = by_case.rollup("cwe").agg(F.count_if(F.col("bad") & F.col("struck")).alias("tp"), F.sum("fp").alias("fp"), F.count_if(F.col("bad") & ~F.col("struck")).alias("fn"), F.sum("tn").alias("tn"))
    variants = by_case.where("bad").groupBy("cwe", "variant").agg(F.count_if("struck").alias("tp"), F.count_if(~F.col("struck")).alias("fn")).withColumn("recall", F.col("tp") / (F.col("tp") + F.col("fn")))
    return measures.metrics(tallies), variants


def unmapped(files: DataFrame, mapping: dict | None = None) -> DataFrame:
    """Weaknesses of test cases that no rule is meant for."""
    return files.select("cwe").distinct().where(~F.col("cwe").isin([*(mapping or MAPPING)]))

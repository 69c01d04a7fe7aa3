"""Operators on findings: line patterns, fingerprints, order, suppression, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.scalars import fingerprint, severity_rank, snippet


def lines(files: DataFrame) -> DataFrame:
    """A row for each line (from 1); a final empty line is none."""
    parts = F.split("text", "\r?\n")
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return files.select(*[c for c in files.columns if c != "text"], F.posexplode(parts).alias("at", "line_text")).withColumn("line", F.col("at") + 1).drop("at")


def line_findings(files: DataFrame, rules: list[dict]) -> DataFrame:
    """All matches of each line rule in each line of files of its languages. rules: id, severity, pattern, and maybe langs
    (all), unless (a pattern that a match must not have). The rules become one array per line, so lines are read once; a rule's
    pattern is tried only where its languages fit."""
    none = F.array().cast("array<string>")
    hits = []
    for r in rules:
        fits = F.col("lang").isin(*r["langs"]) if r.get("langs") else F.lit(True)
        found = F.when(fits & F.col("line_text").rlike(r["pattern"]), F.regexp_extract_all("line_text", F.lit(r["pattern"]), F.lit(0))).otherwise(none)
        hits.append(_hits(r, found))
    out = lines(files).withColumn("all", F.flatten(F.array(*hits))).where(F.size("all") > 0).withColumn("hit", F.explode("all")).drop("all")
    # where a match starts: after the pieces and the matches before it
    pieces = F.split("line_text", F.col("pattern"))
    before = F.concat(F.array_join(F.slice(pieces, F.lit(1), F.col("nth") + 1), ""), F.array_join(F.slice("earlier", F.lit(1), F.col("nth")), ""))
    return out.select(
        *[c for c in out.columns if c not in ("hit", "line_text")], "hit.*", "line_text"
    ).withColumns({"start_col": F.octet_length(before) + 1, "severity_rank": severity_rank(F.col("severity")), "snippet": snippet(F.col("line_text"))}).drop("line_text", "pattern", "earlier", "nth")


def _hits(r: dict, found: Column) -> Column:
    hit = F.transform(found, lambda m, i: F.struct(F.lit(r["id"]).alias("rule_id"), F.lit(r["severity"]).alias("severity"), m.alias("match"), i.alias("nth"), F.lit(r["pattern"]).alias("pattern"), found.alias("earlier")))
    return F.filter(hit, lambda h: ~h["match"].rlike(r["unless"])) if r.get("unless") else hit


def with_fingerprints(findings: DataFrame) -> DataFrame:
    """Adds occurrence (which finding of its rule and snippet in its file) and fingerprint."""
    order = Window.partitionBy("path", "rule_id", "snippet").orderBy("line", "start_col")
    out = findings.withColumn("occurrence", F.row_number().over(order) - 1)
    return out.withColumn("fingerprint", fingerprint(F.col("rule_id"), F.col("path"), F.col("snippet"), F.col("occurrence")))


def one_each(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def report_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.desc("severity_rank"), "path", "line", "start_col", "rule_id")


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity", "severity_rank").agg(F.count("*").alias("n"))


def exceeds(findings: DataFrame, threshold: int | None) -> DataFrame:
    """One row: the largest rank, and whether a gate at this rank fails; no threshold never fails."""
    worst = F.coalesce(F.max("severity_rank"), F.lit(-1))
    return findings.agg(worst.alias("worst"), (F.lit(False) if threshold is None else worst >= threshold).alias("fails"))


def suppress(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    return findings.join(baseline.select("fingerprint").distinct(), "fingerprint", "left_anti")


def rollup(findings: DataFrame) -> DataFrame:
    """Counts by language and rule, by language, and in all."""
    return findings.rollup("lang", "rule_id").agg(F.count("*").alias("n"), F.countDistinct("path").alias("files"), F.max("severity_rank").alias("worst"))


def rule_index(findings: DataFrame) -> DataFrame:
    """Rules that fired, each with its place (from 0) by id."""
    fired = findings.select("rule_id", "severity").distinct()
    return fired.withColumn("rule_index", F.row_number().over(Window.orderBy("rule_id")) - 1)

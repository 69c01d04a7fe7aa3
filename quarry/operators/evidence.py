"""Rules held against annotated fixtures: `expect <rule>` and `expect-not <rule>` in a comment on the line, or on a line of its
own for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .findings import lines
from .measures import outcomes, precision_tier

NOTE = r"(?://|#|;|--|\{|\(\*)\s*expect(-not)?:?\s+([A-Za-z0-9_.-]+)"


def expectations(files: DataFrame) -> DataFrame:
    """path, line, rule_id, expect of the annotations in files (path, text)."""
    notes = F.regexp_extract_all("line_text", F.lit(NOTE), F.lit(0))
    found = lines(files.select("path", "text")).withColumn("note", F.explode(notes))
    alone = F.regexp_replace("line_text", NOTE, "").rlike(r"^\s*(\*\)|\}|\*/)?\s*$")
    return found.select("path", (F.col("line") + alone.cast("int")).alias("line"), F.regexp_extract("note", NOTE, 2).alias("rule_id"), (F.regexp_extract("note", NOTE, 1) == "").alias("expect")).distinct()


def verify(files: DataFrame, findings: DataFrame) -> DataFrame:
    """rule_id, positives, negatives, failures (array of path:line what), tier: each rule over all its annotated files. A
    finding of an annotated rule on a line without annotation is a failure."""
    want = expectations(files)
    own = findings.join(want.select("rule_id", "path").distinct(), ["rule_id", "path"], "left_semi")
    got = own.groupBy("path", "line", "rule_id").agg(F.count("*").alias("n"))
    all_ = outcomes(want, got, ["path", "line", "rule_id"])
    wrong = F.when(F.col("outcome").isin("missed", "unwanted", "unannotated"), F.concat_ws(" ", F.concat_ws(":", "path", "line"), "outcome"))
    out = all_.groupBy("rule_id").agg(F.count_if(F.col("outcome") == "positive").alias("positives"), F.count_if(F.col("outcome") == "negative").alias("negatives"), F.array_sort(F.collect_list(wrong)).alias("failures"))
    return out.withColumn("tier", precision_tier(F.col("positives"), F.col("negatives")))


def recorded(verified: DataFrame) -> DataFrame:
    """What may be written down as evidence: rules without a failure."""
    return verified.where(F.size("failures") == 0).select("rule_id", "positives", "negatives").orderBy("rule_id")


def write(path: str, rows: list) -> None:
    """Evidence as YAML: positives and negatives of each rule without a failure, by id. A row a rule."""
    lines = ["# Written by `rules verify`; measured, not edited."]
    lines += [f"{r['rule_id']}: {{positives: {r['positives']}, negatives: {r['negatives']}}}" for r in sorted(rows, key=lambda r: r["rule_id"])]
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def read(path: str) -> dict:
    """rule to (positives, negatives)."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return {k: (v["positives"], v["negatives"]) for k, v in (yaml.safe_load(f) or {}).items()}

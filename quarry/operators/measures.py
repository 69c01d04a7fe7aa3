"""Coverage, evidence and benchmark measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def precision_tier(positives: Column, negatives: Column) -> Column:
    return F.when((positives >= 2) & (negatives >= 2), "high").when((positives >= 1) & (negatives >= 1), "medium").otherwise("low")


def coverage(rules: DataFrame) -> DataFrame:
    """lang, rules, cwes, owasps of rules (rule_id, langs, cwe, owasp as arrays), and a row "all" where a rule counts once."""
    flat = rules.select("rule_id", F.explode("langs").alias("lang"), "cwe", "owasp")
    flat = flat.unionByName(rules.select("rule_id", F.lit("all").alias("lang"), "cwe", "owasp"))
    tags = lambda c: flat.select("lang", F.explode(c).alias("tag")).groupBy("lang").agg(F.countDistinct("tag").alias(c + "s"))
    return flat.groupBy("lang").agg(F.countDistinct("rule_id").alias("rules")).join(tags("cwe"), "lang", "left").join(tags("owasp"), "lang", "left").fillna(0, ["cwes", "owasps"])


def outcomes(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of expectations (expect) with counts of findings (n): each key's outcome. Findings where nothing was
    expected are mismatches too."""
    both = expected.join(found, keys, "full_outer")
    n = F.coalesce("n", F.lit(0))
    what = F.when(F.col("expect").isNull(), "unannotated").when(F.col("expect") & (n > 0), "positive").when(F.col("expect"), "missed").when(n > 0, "unwanted").otherwise("negative")
    return both.withColumn("outcome", what)


def metrics(tallies: DataFrame) -> DataFrame:
    """precision, recall, fpr, f1, youden of tp, fp, fn, tn; precision and recall of nothing are 1, rates of nothing 0."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    share = lambda a, b, other: F.when(b > 0, a / b).otherwise(other)
    out = tallies.withColumns({"precision": share(tp, tp + fp, 1.0), "recall": share(tp, tp + fn, 1.0), "fpr": share(fp, fp + tn, 0.0)})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumns({"f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), "youden": r - F.col("fpr")})


def passed(rows: DataFrame, ok: Column) -> DataFrame:
    """One row: how many rows there are, how many pass, and their share (1 of none)."""
    out = rows.agg(F.count("*").alias("total"), F.count_if(ok).alias("passed"))
    return out.withColumn("ratio", F.when(F.col("total") > 0, F.col("passed") / F.col("total")).otherwise(1.0))

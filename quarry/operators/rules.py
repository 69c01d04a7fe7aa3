"""Rules that are tree patterns: declarative rows in, findings out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.scalars import message, severity_rank, snippet
from quarry.plans import treequery
from quarry.sources.store import materialised

from .findings import one_each


def filter_column(f: dict, text: Column) -> Column:
    """All tests of a filter hold, or with negate do not; a missing capture passes only a negated filter."""
    ok = F.lit(True)
    if "pattern" in f:
        ok &= text.rlike(f["pattern"])
    if "equals" in f:
        ok &= text == f["equals"]
    if "any_of" in f:
        ok &= text.isin(*f["any_of"])
    negate = f.get("negate", False)
    return F.coalesce(ok != F.lit(negate), F.lit(negate))


def pattern_findings(nodes: DataFrame, files: DataFrame, rules: list[dict]) -> DataFrame:
    """Findings of pattern rules: nodes from a front-end, files with path and text. One per rule and reported span."""
    base = materialised(treequery.prepared(nodes))  # parsed once for all rules
    parts = []
    for r in rules:
        hits = treequery.run(r["query"], base)
        names = [c[2:] for c in hits.columns if c.startswith("c_")]
        for f in r.get("filters", ()):
            hits = hits.where(filter_column(f, F.col(f"c_{f['capture']}")["text"] if f["capture"] in names else F.lit(None).cast("string")))
        node = F.col("c_finding" if "finding" in names else f"c_{names[0]}")
        text = message(r.get("message", r["id"]), {n: F.col(f"c_{n}")["text"] for n in names})
        hits = hits.select("path", F.lit(r["id"]).alias("rule_id"), F.lit(r["severity"]).alias("severity"), F.lit(r.get("category", "security")).alias("category"), text.alias("message"), *[node[c].alias(c) for c in ("start_byte", "end_byte", "start_line", "start_col", "end_line", "end_col")])
        parts.append(hits)
    found = one_each(reduce(lambda a, b: a.unionByName(b), parts), ["path", "rule_id", "start_byte", "end_byte"], ["message"])
    line = F.element_at(F.split("text", "\r?\n"), F.col("start_line"))
    texts = files.select("path", "text").join(found.select("path").distinct(), "path", "left_semi")
    return found.join(texts, "path").withColumns({"severity_rank": severity_rank(F.col("severity")), "snippet": snippet(line)}).drop("text").withColumnRenamed("start_line", "line")

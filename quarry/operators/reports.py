"""Findings as JSON, SARIF 2.1.0 and text for people."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.scalars import SEVERITIES, sarif_level, security_severity, truncate

from .documents import Document, Section
from .findings import report_order, rule_index
from .prefix import running

VERSION = "0.1.0"
SCHEMA = "quarry.findings/1"
FORMATS = ("human", "text", "json", "sarif")


def format_of(name: str) -> str:
    low = name.lower()
    if low not in FORMATS:
        raise ValueError(f"unknown format {name!r}; one of {', '.join(FORMATS)}")
    return "human" if low == "text" else low


def as_json(findings: DataFrame) -> DataFrame:
    """One JSON object per finding, in report order by place; nulls and empty lists are left out."""
    return report_order(findings).select("path", F.to_json(F.struct(*_json_columns(findings))).alias("finding"))


def _json_columns(findings: DataFrame) -> list[Column]:
    return [F.when(F.size(c) > 0, F.col(c)).alias(c) if t.startswith("array") else F.col(c) for c, t in findings.dtypes if c != "severity_rank"]


def with_frames(findings: DataFrame, files: DataFrame) -> DataFrame:
    """findings with frame: the lines (number, text, whether the finding is in it) from two above its first to the end of its
    span, at most four below the first; texts are cut at FRAME characters."""
    first, last = F.greatest(F.lit(1), F.col("line") - 2), F.least(F.col("line") + 4, F.greatest("line", "end_line"))
    lines = F.slice(F.split("text", "\r?\n"), first, last - first + 1)
    frame = F.transform(lines, lambda t, i: F.struct((first + i).cast("int").alias("number"), F.substring(t, 1, FRAME).alias("text"), (first + i >= F.col("line")).alias("inside")))
    return findings.join(files.select("path", "text"), "path", "left").withColumn("frame", frame).drop("text")


def caret(text: str, col: int, width: int) -> str:
    """A line of carets below a line's part; columns count bytes."""
    shown = text.encode("utf-8")[: col - 1].decode("utf-8", "replace")
    return re.sub(r"\S", " ", shown) + "^" * max(1, min(CARETS, width, max(1, len(text) - len(shown))))


#: Characters of a frame's line, carets at most, characters of a flow's line.
FRAME, CARETS, STEP_TEXT = 160, 120, 90
COLOURS = {"critical": "1;31", "high": "31", "medium": "33", "low": "36", "info": "2"}


def wants_colour(choice: str, out) -> bool:
    """auto: on a terminal and unless NO_COLOR is set."""
    return choice == "always" or choice == "auto" and hasattr(out, "isatty") and out.isatty() and not os.environ.get("NO_COLOR")


def paint(text: str, severity: str, on: bool) -> str:
    return f"\x1b[{COLOURS[severity]}m{text}\x1b[0m" if on and severity in COLOURS else text


def human_document(findings: DataFrame, colour: bool = False) -> Document:
    """Text for a terminal: files in order, worst findings first, each with its frame, flow, tags and fix where it has them, then a
    count per severity. Executors make the lines of each finding; which is its file's first is known from the one before it."""
    some = [c for c in ("frame", "trace", "message", "fix", "cwe", "owasp", "end_line", "start", "end") if c in findings.columns]
    shown = findings.select("path", "line", "start_col", "severity", "severity_rank", "rule_id", truncate(F.col("snippet"), 160).alias("snippet"), *some)
    counts = {r["severity"]: r["count"] for r in shown.groupBy("severity").count().collect()}  # a row a severity
    rows = running(shown, [], ["path", F.desc("severity_rank"), "line", "start_col", "rule_id"], "_before", "max", F.col("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = ["\n".join(human_lines(r, colour)) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("path", "severity_rank", "line", "start_col", "rule_id")), pa.array(lines, pa.string())], ["path", "severity_rank", "line", "start_col", "rule_id", "text"])

    kinds = dict(rows.dtypes)
    made = rows.mapInArrow(run, f"path string, severity_rank {kinds['severity_rank']}, line {kinds['line']}, start_col {kinds['start_col']}, rule_id string, text string")
    made = made.select("path", "severity_rank", F.col("line").alias("at"), "start_col", "rule_id", F.col("text").alias("line"))
    total = ", ".join(f"{counts[s]} {s}" for s in reversed(SEVERITIES) if counts.get(s))
    return Document([Section("", made, ["path", F.desc("severity_rank"), "at", "start_col", "rule_id"])], f"{sum(counts.values())} findings" + (f" ({total})" if total else ""))


def human_lines(r: dict, colour: bool) -> Iterator[str]:
    """The lines of one finding, its file's name first where it is the file's first."""
    if r["_before"] != r["path"]:
        yield r["path"]
    severity, frame = r["severity"], r.get("frame")
    yield f"  {r['line']}:{r['start_col']}  {paint(f'{severity:<8}', severity, colour)}  {r['rule_id']}" + (f"  {r['message']}" if r.get("message") else "")
    for k in frame or []:
        yield f"      {k['number']:>5} | {k['text']}"
        if k["number"] == r["line"]:
            width = r["end"] - r["start"] if "start" in r and r["end_line"] == r["line"] else 1 << 30
            yield "            | " + caret(k["text"], r["start_col"], width)
    if not frame:
        yield f"      {r['snippet']}"
    for k, step in enumerate(r.get("trace") or [], 1):
        text = step["snippet"] or ""
        yield f"      {k}. {step['file'] + ':' if step['file'] else ''}{step['line']}  {step['label']}  {text if len(text) <= STEP_TEXT else text[:STEP_TEXT] + '…'}"
    tags = [*(r.get("cwe") or []), *(r.get("owasp") or [])]
    if tags:
        yield "      " + ", ".join(tags)
    if r.get("fix"):
        yield f"      fix: {r['fix']}"


def human(findings: DataFrame, colour: bool = False) -> Iterator[str]:
    """The lines of human_document, one at a time."""
    for block in human_document(findings, colour).lines():
        yield from block.split("\n")


def _in_order() -> list:
    return [F.desc("severity_rank"), "path", "at", "start_col", "rule_id"]


def json_document(findings: DataFrame, stats: dict, errors: DataFrame | None = None) -> Document:
    """One JSON document: schema, version, findings in report order, stats, errors."""
    cols = _json_columns(findings)
    rows = findings.select("severity_rank", "path", F.col("line").alias("at"), "start_col", "rule_id", F.to_json(F.struct(*cols)).alias("line"))
    sections = [Section("{" + f'"schema": "{SCHEMA}", "version": "{VERSION}", "findings": [', rows, _in_order(), ",")]
    sections.append(Section(f'], "stats": {json.dumps(stats)}, "errors": [', None if errors is None else errors.select(F.to_json(F.struct("*")).alias("line")), ["line"], ","))
    return Document(sections, "]}")


def json_lines(findings: DataFrame, stats: dict, errors: DataFrame | None = None) -> Iterator[str]:
    return json_document(findings, stats, errors).lines()


def sarif_tags(cwe: Column, owasp: Column, nist: Column, tags: Column) -> Column:
    """external/cwe/..., owasp/..., nist/..., and a rule's own tags."""
    empty = F.array().cast("array<string>")
    named = lambda c, prefix: F.transform(F.coalesce(c, empty), lambda x: F.concat(F.lit(prefix), x))
    return F.concat(F.transform(F.coalesce(cwe, empty), lambda x: F.concat(F.lit("external/cwe/"), F.lower(x))), named(owasp, "owasp/"), named(nist, "nist/"), F.coalesce(tags, empty))


def help_text(description: Column, fix: Column, message: Column) -> Column:
    """What a rule is about and what to do; its message where it says neither."""
    both = F.concat_ws("\n\n", description, fix)
    return F.when(both == "", message).otherwise(both)


def sarif_document(findings: DataFrame, rules: DataFrame) -> Document:
    """A SARIF document: rules that fired, by id, then a result a line, with a code flow where there is a trace."""
    fired = findings.select("rule_id").distinct()
    known = fired.join(rules, "rule_id", "left").withColumn("severity", F.coalesce("severity", F.lit("medium")))
    properties = F.struct(sarif_tags(F.col("cwe"), F.col("owasp"), F.col("nist"), F.col("tags")).alias("tags"), security_severity(F.col("severity")).alias("security-severity"), F.coalesce("precision", F.lit("low")).alias("precision"))
    said = F.struct(help_text(F.col("description"), F.col("fix"), F.coalesce("message", "rule_id")).alias("text"))
    rule = F.struct(F.col("rule_id").alias("id"), F.coalesce("name", "rule_id").alias("name"), F.struct(F.coalesce("message", "rule_id").alias("text")).alias("shortDescription"), said.alias("help"), F.struct(sarif_level(F.col("severity")).alias("level")).alias("defaultConfiguration"), properties.alias("properties"))
    described = known.orderBy("rule_id").select("rule_id", F.to_json(rule).alias("rule")).collect()  # a row a rule
    head = '{"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": "quarry", "version": "' + VERSION + '", "rules": [' + ", ".join(r.rule for r in described) + ']}},\n"columnKind": "utf16CodeUnits", "results": ['
    results = sarif_results(findings, rule_index(findings)).select("severity_rank", "path", F.col("line").alias("at"), "start_col", "rule_id", F.col("result").alias("line"))
    return Document([Section(head, results, _in_order(), ",")], "]}]}")


def sarif_lines(findings: DataFrame, rules: DataFrame) -> Iterator[str]:
    return sarif_document(findings, rules).lines()


def sarif_results(findings: DataFrame, index: DataFrame) -> DataFrame:
    """result, and what a report is ordered by: each finding as a JSON object, with its rule's place (index: rule_id, rule_index, some hundred rows), its place in the
    file, its fingerprint and, where it has a trace, a code flow. Null parts are left out."""
    has = findings.columns
    place = lambda path, line, col, text: F.struct(F.struct(path.alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"), F.struct(line.alias("startLine"), col.alias("startColumn"), F.struct(text.alias("text")).alias("snippet")).alias("region"))
    step = lambda s: F.struct(F.struct(place(F.coalesce(s["file"], F.col("path")), s["line"], s["col"], s["snippet"]).alias("physicalLocation"), F.struct(s["label"].alias("text")).alias("message")).alias("location"))
    flows = [F.when(F.size("trace") > 0, F.array(F.struct(F.array(F.struct(F.transform("trace", step).alias("locations"))).alias("threadFlows")))).alias("codeFlows")] if "trace" in has else []
    said = F.col("message") if "message" in has else F.col("rule_id")
    own = F.array(F.struct(place(F.col("path"), F.col("line"), F.col("start_col"), F.col("snippet")).alias("physicalLocation")))
    result = F.struct(F.col("rule_id").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), sarif_level(F.coalesce("severity", F.lit("medium"))).alias("level"), F.struct(said.alias("text")).alias("message"), own.alias("locations"), F.struct(F.col("fingerprint").alias("finding/v1")).alias("partialFingerprints"), *flows)
    return findings.join(F.broadcast(index.select("rule_id", "rule_index")), "rule_id", "left").select("severity_rank", "path", "line", "start_col", "rule_id", F.to_json(result).alias("result"))


def write(document: Document | Iterator[str], out: str | None) -> None:
    """To a file, to a folder of fragments with a manifest (a name that ends in a slash), or to the terminal; a few lines that the
    driver made itself go to the terminal."""
    if out is None:
        for line in document.lines() if isinstance(document, Document) else document:
            print(line)
    elif out.endswith("/"):
        document.publish(out.rstrip("/"))
    else:
        document.write(out)

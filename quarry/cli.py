"""The command line: scan, rules, languages, parse, explain, coverage, baseline, cache. Exit codes: 0 nothing to report, 1 findings at
or above the threshold (or fixtures that fail), 2 an error."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry import scan as engine
from quarry import state
from quarry.operators import evidence, measures, reports, rulebook
from quarry.sources import corpus, facts

#: The ten kinds of risk and the 25 kinds of weakness that coverage is counted by.
OWASP = [f"A{k:02d}:2021" for k in range(1, 11)]
CWE25 = ["CWE-787", "CWE-79", "CWE-89", "CWE-416", "CWE-78", "CWE-20", "CWE-125", "CWE-22", "CWE-352", "CWE-434", "CWE-862", "CWE-476", "CWE-287", "CWE-190", "CWE-502", "CWE-77", "CWE-119", "CWE-798", "CWE-918", "CWE-306", "CWE-362", "CWE-269", "CWE-94", "CWE-863", "CWE-276"]


def session(jobs: int | None = None) -> SparkSession:
    """The session there is, else a local one."""
    active = SparkSession.getActiveSession()
    if active:
        return active
    made = SparkSession.builder.appName("quarry").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
    if jobs:
        made = made.master(f"local[{jobs}]").config("spark.sql.shuffle.partitions", str(jobs))
    spark = made.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quarry", description=__doc__)
    top.add_argument("--config")
    top.add_argument("--root")
    sub = top.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan")
    s.add_argument("paths", nargs="*")
    s.add_argument("--diff-base")
    s.add_argument("--format", default="human")
    s.add_argument("--output")
    s.add_argument("--sarif-out")
    s.add_argument("--rules", action="append")
    s.add_argument("--no-default-rules", action="store_true", default=None)
    s.add_argument("--rule", action="append", dest="only_rules")
    s.add_argument("--lang", action="append", dest="langs")
    s.add_argument("--include", action="append")
    s.add_argument("--exclude", action="append")
    s.add_argument("--no-cache", action="store_true", default=None)
    s.add_argument("--no-ignore", action="store_true", default=None)
    s.add_argument("--baseline")
    s.add_argument("--fail-on", choices=["never", *engine.SEVERITY_ORDER])
    s.add_argument("--jobs", type=int)
    s.add_argument("--max-file-size", type=int)
    s.add_argument("--color", default="auto", choices=["auto", "always", "never"])
    s.add_argument("--verbose", action="store_true")
    r = sub.add_parser("rules")
    r.add_argument("action", choices=["list", "verify"])
    r.add_argument("--rules", action="append")
    r.add_argument("--fixtures")
    r.add_argument("--write-evidence")
    r.add_argument("--verbose", action="store_true")
    sub.add_parser("languages")
    p = sub.add_parser("parse")
    p.add_argument("file")
    p.add_argument("--lang")
    p.add_argument("--all", action="store_true")
    p.add_argument("--query")
    e = sub.add_parser("explain")
    e.add_argument("file")
    e.add_argument("--lang")
    e.add_argument("--rule", action="append")
    e.add_argument("--format", default="human", choices=["human", "json"])
    c = sub.add_parser("coverage")
    c.add_argument("--format", default="human", choices=["human", "json"])
    b = sub.add_parser("baseline")
    b.add_argument("action", choices=["update", "info"])
    b.add_argument("file")
    k = sub.add_parser("cache")
    k.add_argument("action", choices=["info", "clear"])
    return top


def language_of(path: str, named: str | None, extensions: dict) -> str:
    """The language that is named, else the one of the file's ending."""
    known = {e: l for l, es in reversed(corpus.EXTENSIONS.items()) for e in es} | extensions
    lang = named or known.get(Path(path).suffix.lower().lstrip("."))
    if lang not in facts.LANGUAGES:
        raise engine.ScanError(f"no language for {path}")
    return lang


def coverage(spark: SparkSession, rules: list[dict]) -> dict:
    """By language and in all: rules, kinds of weakness, items of both lists that are there and that are missing."""
    table = rulebook.table(spark, rules).withColumn("langs", F.col("languages")).cache()
    rows = {r["lang"]: {"rules": r["rules"], "cwes": r["cwes"], "owasp": r["owasps"]} for r in measures.coverage(table).collect()}  # a row a language
    tags = {lang: {t for r in rules if lang in ("all", *r["languages"]) for t in [*r["cwe"], *r["owasp"]]} for lang in rows}
    for lang, row in rows.items():
        row |= {"owasp_missing": [x for x in OWASP if x not in tags[lang]], "cwe25": sum(x in tags[lang] for x in CWE25), "cwe25_missing": [x for x in CWE25 if x not in tags[lang]]}
    return rows


def verified(spark: SparkSession, rules: list[dict], folder: str):
    """All rules over their fixtures (<lang>/tests/<rule>/ or tests/<rule>/ below the folder), each rule in its own folder only."""
    files = corpus.read_folder(spark, folder).withColumn("owner", F.regexp_extract("path", r"(?:^|/)tests/([^/]+)/[^/]+$", 1)).where("owner <> ''")
    found = engine.analyse(spark, files.drop("owner"), rules, engine.Options(root=folder, no_cache=True)).findings
    return evidence.verify(files, found.join(files.select("path", F.col("owner").alias("rule_id")), ["path", "rule_id"], "left_semi"))


def main(argv: list[str] | None = None) -> int:
    args = arguments().parse_args(argv)
    try:
        return run(args)
    except (engine.ScanError, rulebook.RuleError, state.StateError, ValueError, OSError) as e:
        print(f"quarry: {e}", file=sys.stderr)
        return 2


def run(args: argparse.Namespace) -> int:
    root = args.root or engine.repository(".")
    config = engine.configured(root, args.config)
    if args.command == "scan":
        form = reports.format_of(args.format)
        keys = ("paths", "diff_base", "rules", "no_default_rules", "only_rules", "langs", "include", "exclude", "no_cache", "no_ignore", "baseline", "fail_on", "max_file_size")
        opts = engine.options(config, root=root, **{k: getattr(args, k) for k in keys})
        spark = session(args.jobs)
        result = engine.scan(spark, opts)
        for w in rulebook.shown(result.warnings, args.verbose):
            print(f"warning: {w}", file=sys.stderr)
        table = rulebook.table(spark, result.rules)
        if form == "human":
            texts = corpus.read_folder(spark, root, opts.extensions)
            colour = args.output is None and reports.wants_colour(args.color, sys.stdout)
            reports.write(reports.human_document(reports.with_frames(result.findings, texts), colour), args.output)
        else:
            reports.write(reports.json_document(result.findings, result.stats, result.errors) if form == "json" else reports.sarif_document(result.findings, table), args.output)
        if args.sarif_out:
            reports.write(reports.sarif_document(result.findings, table), args.sarif_out)
        if args.verbose:
            print(json.dumps(result.stats), file=sys.stderr)
        return int(result.fails(opts.fail_on))
    if args.command == "cache":
        session()
        if args.action == "clear":
            print("cleared" if state.clear_caches(root, config.get("state")) else "nothing there")
        else:
            print(json.dumps(state.info(root, config.get("state"))))
        return 0
    if args.command == "baseline":
        if args.action == "info":
            print(json.dumps(state.baseline_info(session(), args.file)))
        else:
            print(f"{state.write_baseline(args.file, engine.scan(session(), engine.options(config, root=root)).findings)} fingerprints")
        return 0
    rules, warnings = rulebook.load([*config.get("rules", []), *(getattr(args, "rules", None) or [])], disabled=config.get("disable_rules", []))
    if args.command == "rules":
        spark = session()
        for w in rulebook.shown(warnings, args.verbose):
            print(f"warning: {w}", file=sys.stderr)
        if args.action == "list":
            for r in rulebook.listing(rulebook.table(spark, rules), args.verbose).collect():
                print("  ".join(str(v) for v in r))
            return 0
        folder = args.fixtures or str(rulebook.BUILTIN)
        done = verified(spark, rules, folder).collect()
        for r in done:
            print(f"{'ok  ' if not r.failures else 'FAIL'}  {r.rule_id}  +{r.positives} -{r.negatives}  {r.tier}")
            for f in r.failures:
                print(f"      {f}")
        passed = sum(not r.failures for r in done)
        print(f"{passed} of {len(done)} rules verified")
        if args.write_evidence:
            evidence.write(args.write_evidence, [r for r in done if not r.failures])
        return int(passed < len(done))
    if args.command == "languages":
        for r in rulebook.languages_table(session()).collect():
            print(f"{r.lang}  {r.name}  {','.join(r.extensions)}  {'external' if r.external else 'built in'}  {'data flow' if r.dataflow else '-'}")
        return 0
    if args.command == "coverage":
        rows = coverage(session(), rules)
        if args.format == "json":
            print(json.dumps(rows, indent=1))
        else:
            for lang in sorted(rows):
                r = rows[lang]
                print(f"{lang}  {r['rules']} rules  OWASP {10 - len(r['owasp_missing'])}/10  CWE 25 {r['cwe25']}/25  {r['cwes']} CWEs")
            print("missing: " + ", ".join([*rows["all"]["owasp_missing"], *rows["all"]["cwe25_missing"]]))
        return 0
    lang = language_of(args.file, args.lang, config.get("extensions", {}))
    text = Path(args.file).read_bytes().decode("utf-8", "replace")
    if args.command == "explain":
        chosen = [r for r in rules if not args.rule or r["id"] in args.rule]
        doc = engine.explain(args.file, lang, text, chosen)
        if args.format == "json":
            print(json.dumps(doc, indent=1))
        else:
            print("\n".join([f"{doc['path']} ({lang})", *(f"  function {f['name']}  {f['from']}-{f['to']}" for f in doc["functions"]), *(f"  {c['line']}  {c['target']}: {c['is']}" for c in doc["calls"]), *(f"  {v['line']}  {v['rule_id']}: {v['verdict']}" for v in doc["sinks"])]))
        return 0
    tree = facts.LANGUAGES[lang].parse(text)
    if args.query:
        from quarry.plans import treequery

        files = session().createDataFrame([(args.file, lang, text)], "path string, lang string, text string")
        hits = treequery.run(args.query, treequery.prepared(facts.nodes(files)))
        for k, row in enumerate(hits.collect()):
            for c in hits.columns[1:]:
                if row[c] is not None:
                    print(f"{k}  @{c[2:]}  {row[c].start_line}:{row[c].start_col}  {row[c].kind}  {row[c].text[:80]}")
        return 0
    reports.write(dump(tree, text, args.all), None)
    return 0


def dump(root: facts.Node, text: str, every: bool = False):
    """A tree's nodes in preorder, with field, kind, range, and the text of leaves up to 60 characters."""
    from quarry.sources.tree import Places

    places, todo = Places(text), [(root, None, 0)]
    while todo:
        n, f, depth = todo.pop()
        (_, l1, c1), (_, l2, c2) = places.spot(n.start), places.spot(n.end)
        leaf = "" if n.children else "  " + text[n.start : n.end][:60].replace("\n", "\\n")
        yield f"{'  ' * depth}{f + ': ' if f else ''}{n.kind} {l1}:{c1}-{l2}:{c2}{leaf}"
        todo.extend((c, ff, depth + 1) for ff, c in reversed(n.children) if every or c.kind != "comment")


if __name__ == "__main__":
    sys.exit(main())

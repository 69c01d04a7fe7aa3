import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarry import cli, scan, state
from quarry.operators import binder, dataflow, evidence, reports, rulebook
from quarry.sources import corpus, facts

FIXTURES = str(Path(__file__).parent / "fixtures")
LIB = 'export function readName(req) { return req.query.name; }\nexport function save(db, v) { db.query("insert " + v); }\nexport function same(x) { return x; }\n'
APP = """import { readName } from "./lib/input";
import { save as keep, same } from "./lib/again.js";
function h(req, db) {
  const n = readName(req);
  db.query("select " + n); // found
  keep(db, req.body.v); // found
  keep(db, "fixed");
  db.query(same(req.params.id)); // found
  db.query(same("fixed"));
}
"""


@pytest.fixture
def app(tmp_path):
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "input.js").write_text(LIB)
    (tmp_path / "lib" / "again.js").write_text('import { save, same } from "./input";\nexport { save, same };\n')
    (tmp_path / "app.js").write_text(APP)
    return tmp_path


def lines(result, rule="js.sql-injection"):
    return {(r.path, r.line) for r in result.findings.where(F.col("rule_id") == rule).collect()}


def rows(result):
    return sorted((r.path, r.rule_id, r.line, r.start_col, r.fingerprint, json.dumps([s.asDict() for s in r.trace])) for r in result.findings.collect())


WANT = {("app.js", n) for n, line in enumerate(APP.split("\n"), 1) if "// found" in line}


def test_every_rule_against_its_fixtures(spark):
    rules, warnings = rulebook.load()
    assert len(rules) == 72 and not warnings
    done = cli.verified(spark, rules, FIXTURES).collect()
    assert {r.rule_id for r in done} == {r["id"] for r in rules}
    assert [(r.rule_id, list(r.failures)) for r in done if r.failures] == []
    assert all(r.positives >= 2 and r.negatives >= 2 and r.tier == "high" for r in done)
    assert rulebook.recorded() == {r.rule_id: (r.positives, r.negatives) for r in done}  # what is written down is what is measured


def test_files_are_linked_and_warm_equals_cold(spark, app):
    opts = scan.Options(root=str(app))
    cold = scan.scan(spark, opts)
    assert lines(cold) == WANT
    trace = next(r.trace for r in cold.findings.collect() if r.line == 6)
    assert trace[0].label.startswith("source:") and trace[-1].label.startswith("sink:") and trace[-1].file == "lib/input.js" and trace[-1].line == 2
    assert all(s.line for r in cold.findings.collect() for s in r.trace)
    before = rows(cold)
    warm = scan.scan(spark, opts)
    assert rows(warm) == before and warm.stats["cached"] == 3 and warm.stats["summaries_reused"] == 3
    # an edit of one file changes what is found in another, as it would without a cache
    (app / "lib" / "input.js").write_text(LIB.replace("return req.query.name", "return 1"))
    edited = scan.scan(spark, opts)
    assert lines(edited) == WANT - {("app.js", 5)} and rows(edited) == rows(scan.scan(spark, scan.Options(root=str(app), no_cache=True)))
    assert edited.stats["summarised"] == 1
    assert state.clear_caches(str(app)) and not state.clear_caches(str(app))


def test_scope_of_a_scan(spark, app):
    (app / ".gitignore").write_text("*.min.js\nbuild/\n!keep.min.js\n/only.js\n")
    for name in ("a.min.js", "keep.min.js", "build/x.js", "lib/build/y.js", "only.js", "lib/only.js", ".hidden.js", "big.js", "own.js"):
        (app / name).parent.mkdir(exist_ok=True)
        (app / name).write_text("debugger;\n")
    (app / "big.js").write_text("debugger;" + " " * 5000)
    (app / ".quarryignore").write_text("own.js\n")
    found = lambda **o: {r.path for r in scan.scan(spark, scan.Options(root=str(app), no_cache=True, max_file_size=4000, only_rules=["js.quality.debugger"], **o)).findings.collect()}
    assert found() == {"keep.min.js", "lib/only.js"}
    assert found(no_ignore=True) == {"a.min.js", "keep.min.js", "build/x.js", "lib/build/y.js", "only.js", "lib/only.js"}
    assert found(paths=["lib"]) == {"lib/only.js"} and found(exclude=["lib*"]) == {"keep.min.js"} and found(langs=["go"]) == set()
    assert scan.scan(spark, scan.Options(root=str(app), no_cache=True, max_file_size=4000)).stats["skipped"] == 1
    with pytest.raises(scan.ScanError):
        scan.inside(str(app), ["../elsewhere"])


def test_baseline_config_and_commands(spark, app, capsys, tmp_path_factory):
    base, out = str(app / "base.json"), tmp_path_factory.mktemp("out")
    assert cli.main(["--root", str(app), "baseline", "update", base]) == 0
    assert cli.main(["--root", str(app), "scan", "--baseline", base, "--format", "json", "--output", str(out / "a.json"), "--sarif-out", str(out / "a.sarif")]) == 0
    doc = json.loads((out / "a.json").read_text())
    assert doc["findings"] == [] and doc["stats"]["suppressed"] == len(WANT) and json.loads((out / "a.sarif").read_text())["runs"][0]["results"] == []
    (app / "base.json").write_text("{")
    assert cli.main(["--root", str(app), "scan", "--baseline", base]) == 2
    assert cli.main(["--root", str(app), "scan", "--format", "sarif", "--output", str(out / "b.sarif")]) == 1
    run = json.loads((out / "b.sarif").read_text())["runs"][0]
    rule = run["tool"]["driver"]["rules"][0]
    assert len(run["results"]) == len(WANT) and "external/cwe/cwe-89" in rule["properties"]["tags"] and rule["properties"]["precision"] == "high"
    assert run["results"][0]["codeFlows"][0]["threadFlows"][0]["locations"][0]["location"]["message"]["text"].startswith("source:")
    (app / "quarry.toml").write_text('[scan]\ndisable_rules = ["js.sql-injection"]\nfail_on = "low"\nexclude = ["lib*"]\n[extensions]\nes = "javascript"\n')
    (app / "x.es").write_text("debugger;\n")
    capsys.readouterr()
    assert cli.main(["--root", str(app), "scan"]) == 1
    text = capsys.readouterr().out
    assert "x.es" in text and "1 | debugger;" in text and "^^^^^^^^^" in text and "1 findings (1 low)" in text
    (app / "quarry.toml").write_text("[scan]\nnonsense = 1\n")
    assert cli.main(["--root", str(app), "scan"]) == 2
    (app / "quarry.toml").unlink()
    for args, has in ((["languages"], "objectscript"), (["coverage"], "OWASP 9/10"), (["rules", "list"], "js.xss.dom"), (["parse", str(app / "app.js")], "call_expression"), (["parse", str(app / "app.js"), "--query", "(import_statement) @i"], "@i"), (["--root", str(app), "cache", "info"], "summaries"), (["explain", str(app / "app.js")], "readName of ./lib/input")):
        capsys.readouterr()
        assert cli.main(args) == 0 and has in capsys.readouterr().out
    assert cli.main(["parse", "a.unknown"]) == 2


def found_by(spark, text, sources, sinks, path="app.js"):
    rule = rulebook.expanded({"id": "t.rule", "severity": "high", "languages": ["javascript"], "sources": sources, "sinks": sinks}, {}, None)
    rulebook.validate(rule)
    files = spark.createDataFrame([(path, "javascript", len(text), text, "h", None)], "path string, lang string, size long, text string, content_hash string, read_error string")
    return {r.line for r in scan.analyse(spark, files, [rule], scan.Options(no_cache=True)).findings.collect()}


def test_identity_matchers(spark):
    source = [{"fact": "read", "resolved": {"member_of": "req", "path": ["query"]}}]
    run = "\nfunction h(req) {\n  run(req.query.cmd);\n}\n"
    named = [{"resolved": {"module": "child_process", "name": "exec"}}]
    assert found_by(spark, "import { exec as run } from 'child_process';" + run, source, named) == {3}
    assert found_by(spark, "import { run } from './safe';" + run, source, named) == set()
    assert found_by(spark, "const { exec: run } = require('child_process');" + run, source, named) == {3}
    assert found_by(spark, "const cp = require('child_process');\n\nfunction h(req) { cp.exec(req.query.a); }", source, named) == {3}
    any_query = [{"resolved": {"name": "query"}}]
    assert found_by(spark, "function h(req) {\n  this.conn.query('a' + req.query.id);\n  this.conn.query('a' + req.cookies.id);\n  query(req.query.id);\n}", source, any_query) == {2}
    assert found_by(spark, "function h(req) {\n  query(req.query.id);\n}", source, [{"resolved": {"name": "query", "match_unresolved": True}}]) == {2}


def test_flows_in_one_file(spark):
    source, sink = [{"fact": "read", "target": "/^req\\.q(\\.|$)/"}], [{"target": ["sink"], "take": "arg 0"}]
    text = """function late(req) { sink(x); var x = req.q; sink(x); }
function wrap(a, b) { return b; }
function get(req) { return req.q; }
function use(req) { sink(wrap(1, req.q)); }
function use2(req) { sink(get(req)); }
function last(v) { sink(v); }
function call(req) { last(req.q); }
function field(req) { const o = 1; sink(o.v); let p = req.q; sink(p.w); }
function loop(req) { for (const r of req.q) { sink(r); } let { a, b: c } = req.q; sink(c); sink(b); }
function quiet(v) { sink(v); }
const f = (req) => sink(req.q);
"""
    assert found_by(spark, text, source, sink) == {1, 4, 5, 6, 8, 9, 11}
    doc = scan.explain("a.js", "javascript", text, [rulebook.expanded({"id": "t.rule", "languages": ["javascript"], "sources": source, "sinks": sink}, {}, None)])
    said = [(v["line"], v["verdict"]) for v in doc["sinks"]]
    assert (10, "parameter without a tainted caller") in said and (6, "caller passes a source") in said and (8, "nothing reaches it") in said


def test_binder_relations_agree_with_the_walk(spark, app):
    files = corpus.read_folder(spark, str(app))
    filed = facts.with_facts(files)
    flat = facts.facts(filed)
    imports = dataflow.imports(filed)
    functions = flat.where("fact = 'function' AND name IS NOT NULL").select("path", "name")
    calls = flat.where("fact = 'call'").select("path", "start", "name", "target", "resolution", "symbol", "module")
    got = binder.resolved_calls(calls.select("path", "start", "name", "target"), imports, functions)
    both = calls.alias("a").join(got.alias("b"), ["path", "start"]).select("a.resolution", "a.symbol", "a.module", F.col("b.resolution").alias("r"), F.col("b.symbol").alias("s"), F.col("b.module").alias("m")).collect()
    assert both and all((x.resolution, x.symbol, x.module) == (x.r, x.s, x.m) for x in both)


def test_rules_that_cannot_run(tmp_path):
    part = "{target: [f], take: arg 0}"
    (tmp_path / "a.yaml").write_text(f"""languages: [go]
rules:
  - {{id: t.ok, sources: [{part}], sinks: [{part}]}}
  - {{id: t.ok, severity: low, when: [{{fact: call}}]}}
  - {{severity: low}}
  - {{id: t.a, severity: loud, when: [{part}]}}
  - {{id: t.b, precision: high, when: [{part}]}}
  - {{id: t.c, sources: [{part}]}}
  - {{id: t.d, when: [{part}], query: "(a)"}}
  - {{id: t.e, when: [{{target: '/(/'}}]}}
  - {{id: t.f, when: [{{tarjet: [a]}}]}}
  - {{id: t.g, languages: [cobol], when: [{part}]}}
  - {{id: t.h, query: "((a)"}}
  - {{id: t.i, when: [{{name: [a], resolved: {{name: b}}}}]}}
  - {{id: t.j, when: [other]}}
""")
    rules, warnings = rulebook.load([tmp_path], builtin=False)
    assert [(r["id"], r["kind"]) for r in rules] == [("t.ok", "pattern")] and len(warnings) == 12
    assert len(rulebook.shown(warnings + warnings)) == 8 and rulebook.load([tmp_path], builtin=False, disabled=["t.ok"])[0] == []
    (tmp_path / "b.yaml").write_text("rules: [")
    with pytest.raises(rulebook.RuleError):
        rulebook.load([tmp_path], builtin=False)
    a, b = ({"id": "x", "v": 1}, {"id": "y"})
    assert rulebook.rules_hash([a, b]) == rulebook.rules_hash([b, a]) != rulebook.rules_hash([a])


def test_evidence_is_written_and_read(spark, tmp_path):
    evidence.write(str(tmp_path / "e.yaml"), [{"rule_id": "b", "positives": 2, "negatives": 3}, {"rule_id": "a", "positives": 1, "negatives": 1}])
    known = evidence.read(str(tmp_path / "e.yaml"))
    assert list(known) == ["a", "b"]
    rule = lambda k: rulebook.expanded({"id": k, "languages": ["go"], "when": [{"fact": "call"}]}, {}, None)
    assert [(r.rule_id, r.precision) for r in rulebook.table(spark, [rule("b"), rule("c"), rule("a")], known).collect()] == [("a", "medium"), ("b", "high"), ("c", "low")]


def test_frames_and_colours(spark):
    text = "\n".join(f"line {k}" for k in range(1, 10))
    found = spark.createDataFrame([("a.js", 5, 3, 5, "t.x", "high", 3, "line 5", 10, 13)], "path string, line int, start_col int, end_line int, rule_id string, severity string, severity_rank int, snippet string, start int, `end` int")
    files = spark.createDataFrame([("a.js", text)], "path string, text string")
    frame = reports.with_frames(found, files).first().frame
    assert [f.number for f in frame] == [3, 4, 5] and [f.inside for f in frame] == [False, False, True]
    shown = list(reports.human(reports.with_frames(found, files), colour=True))
    assert "\x1b[31m" in shown[1] and any(s.endswith("|   ^^^") for s in shown)
    assert reports.caret("é = 1", 4, 3) == "  ^^^"

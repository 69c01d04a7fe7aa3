from collections import Counter
from pathlib import Path

import pytest

from quarry.operators import dataflow, rulebook, taint
from quarry.sources import facts

HERE = Path(__file__).parent / "fixtures"
ENDINGS = {".js": "javascript", ".ts": "typescript", ".tsx": "tsx", ".cs": "csharp", ".go": "go", ".rs": "rust", ".pas": "pascal", ".cls": "objectscript", ".mac": "objectscript"}


def fixtures():
    """Every fixture, and files that call, nest, share names and go round in circles."""
    files = [(str(p.relative_to(HERE)), ENDINGS[p.suffix], p.read_text(encoding="utf-8")) for p in sorted(HERE.rglob("*")) if p.suffix in ENDINGS]
    more = {
        "ring.js": "function h(req){ let a = req.query.x; let b; for(;;){ b = c; c = d.e; d = a; } var c; eval(b); }",
        "late.js": "function h(req){ let a; eval(a); a = req.query.x; eval(a); function g(){ eval(a); } }",
        "calls.js": "function id(x){ return x; } function src(req){ return req.query.q; } function h(req){ const v = id(src(req)); eval(v); } function sink(y){ eval(y); } function mid(z){ sink(z); } function top(req){ mid(req.body); }",
        "fields.js": "function h(req){ const o = {}; o.a.b = req.query.x; eval(o.a); eval(o.c); eval(o); let p = o.a.b.c.d; eval(p); }",
        "deep.js": "function h(req){ let a0 = req.query.x;" + "".join(f" let a{i + 1} = a{i};" for i in range(20)) + " eval(a20); }",
        "five.js": "function f1(a){ eval(a); } function f2(a){ f1(a); } function f3(a){ f2(a); } function f4(a){ f3(a); } function f5(req){ f4(req.query.x); }",
        "empty.js": "",
    }
    return files + [(name, "javascript", text) for name, text in more.items()]


@pytest.fixture(scope="module")
def solution(spark):
    rules, _ = rulebook.load()
    rows = fixtures()
    filed = facts.with_facts(spark.createDataFrame(rows, "path string, lang string, text string"))
    want = [(path, *dataflow.analyse(path, lang, facts.facts_of(lang, text), rules)) for path, lang, text in rows]
    return taint.Solution(filed, rules), want


def test_verdicts_are_those_of_the_solver_by_files(solution):
    solved, want = solution
    got = Counter((v.path, v.rule_id, v.start, v.end, v.verdict) for v in solved.verdicts().collect())
    other = Counter((path, v["rule_id"], v["start"], v["end"], v["verdict"]) for path, _, _, verdicts in want for v in verdicts)
    assert got == other
    assert {v[4] for v in other} == {"source reaches sink", "caller passes a source", "parameter without a tainted caller", "sanitised", "nothing reaches it"}


def test_summaries_are_those_of_the_solver_by_files(solution):
    solved, want = solution
    got = {(s.path, s.rule_id, s.function): (s.returns_source, s.params, s.sinks) for s in solved.summaries().collect()}
    other = {(path, s["rule_id"], s["function"]): (s["source"] is not None, s["params"], sorted({k["param"] for k in s["sinks"]})) for path, _, summaries, _ in want for s in summaries}
    assert got == other


def test_no_python_worker_and_no_collect(solution):
    solved, _ = solution
    for df in (solved.verdicts(), solved.summaries(), solved.spread.held()):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Python" not in plan and "MapInArrow" not in plan


def test_least_writes_win_and_visibility_follows(spark):
    """An origin that comes to a cell again from an earlier write is seen by reads between the two."""
    none = []
    reads = [("f", 1, 0, "a", none, 50), ("f", 2, 0, "b", none, 5), ("f", 3, 1, "a", ["x"], 2)]
    assigns = [("f", 1, 0, "c", none, 50), ("f", 2, 0, "a", none, 10)]
    put = [("f", "r", 0, "a", none, "s", 60), ("f", "r", 0, "b", none, "s", 4)]
    s = taint.Spread(spark.createDataFrame(reads, "path string, read long, scope int, base string, fields array<string>, at int"), spark.createDataFrame(assigns, "path string, read long, scope int, base string, fields array<string>, at int"), spark.createDataFrame([("f", 1, 0)], "path string, child int, ancestor int"))
    s.grow(spark.createDataFrame(put, "path string, rule string, scope int, base string, fields array<string>, origin string, at int"))
    assert {(c.base, c.at) for c in s.held().collect()} == {("a", 10), ("b", 4), ("c", 50)}
    assert {(x.read, x.origin) for x in s.of_reads().collect()} == {(1, "s"), (2, "s"), (3, "s")}

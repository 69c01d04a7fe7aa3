import pytest
from pyspark.sql import functions as F

from quarry.operators import benchmark, flow, intervals, rulebook
from quarry.operators.findings import line_findings
from quarry.sources import facts
from quarry.sources.tree import Node


def test_dyadic_cells_make_up_their_span(spark):
    spans = spark.createDataFrame([(s, e) for s in range(0, 40, 3) for e in range(s - 1, 60, 7)], "s long, e long")
    rows = intervals.cells(spans).groupBy("s", "e").agg(F.collect_list(F.struct("level", "cell")).alias("c"), F.count("*").alias("n")).collect()
    assert {(r.s, r.e) for r in rows} == {(r.s, r.e) for r in spans.where("s <= e").collect()}
    for r in rows:
        got = [p for c in r.c for p in range(c.cell << c.level, (c.cell + 1) << c.level)]
        assert sorted(got) == list(range(r.s, r.e + 1)) and r.n <= 2 * (r.e - r.s + 1).bit_length()


def test_every_match_of_a_line_has_its_place(spark):
    files = spark.createDataFrame([("a", "en", "x a@b.cd é a@b.cd, example@b.cd a@b.cd"), ("b", "de", "a@b.cd"), ("c", "en", None)], "path string, lang string, text string")
    rules = [{"id": "m", "severity": "low", "pattern": "[a-z]+@[a-z.]+", "unless": "example", "langs": ["en"]}]
    assert sorted((r.path, r.start_col, r.match) for r in line_findings(files, rules).collect()) == [("a", 3, "a@b.cd"), ("a", 13, "a@b.cd"), ("a", 34, "a@b.cd")]


def test_a_caller_of_a_caller(spark):
    sinks = spark.createDataFrame([(1, "f", 0), (2, "f", 1), (3, "a", 0), (4, "d", 0)], "sink_id long, func string, param int")
    calls = [(10, "f", 0, False, "g", 1), (11, "g", 1, True, "h", None), (12, "f", 1, False, "h", None), (13, "a", 0, False, "a", 0), (14, "d", 0, False, "e", 0), (15, "e", 0, False, "i", 0), (16, "i", 0, False, "j", 0), (17, "j", 0, True, "k", None)]
    df = spark.createDataFrame(calls, "call_id long, func string, arg int, source boolean, caller string, caller_param int")
    assert [tuple(r) for r in flow.stitch(sinks, df).collect()] == [(1, 2, 11)]  # four callers away is too far


def test_benchmark_scores_cases_and_regions(spark, tmp_path):
    bad = "class T { void Bad() { var a = new SqlCommand(\"x\" + Request.Form[\"a\"], c); } void GoodOne() { var a = new SqlCommand(\"x\", c); } }\n"
    sink = "class CWE89_X_81_bad { void Action(string d) { var a = new SqlCommand(d, c); } }\n"
    for name, text in {"CWE89_X_01.cs": bad, "CWE89_X_81a.cs": sink, "CWE89_X_81b.cs": "class B { void Bad() { F(); } }\n", "CWE999_X_01.cs": bad, "other.cs": bad}.items():
        (tmp_path / name).write_text(text.replace("} void", "}\nvoid"))
    files = benchmark.cases(spark, str(tmp_path))
    assert sorted((r.cwe, r.testcase, r.variant) for r in files.collect()) == [("CWE-89", "CWE89_X_01", "baseline"), ("CWE-89", "CWE89_X_81", "flow-variant"), ("CWE-89", "CWE89_X_81", "flow-variant"), ("CWE-999", "CWE999_X_01", "baseline")]
    from quarry import scan

    found = scan.analyse(spark, files, rulebook.load()[0], scan.Options(no_cache=True)).findings
    tallies, variants = benchmark.score(files, benchmark.regions(facts.with_facts(files)), found)
    rows = {r.cwe: r for r in tallies.collect()}
    assert set(rows) == {"CWE-89", None} and (rows[None].tp, rows[None].fp, rows[None].fn, rows[None].tn) == (1, 0, 1, 1)
    assert {(r.variant, r.recall) for r in variants.collect()} == {("baseline", 1.0), ("flow-variant", 0.0)}
    assert [r.cwe for r in benchmark.unmapped(files).collect()] == ["CWE-999"]
    code = 'a /* "x" */ = "//"; // b\nc'
    assert benchmark.stripped(code) == "a           =     ;     \nc"


def test_a_front_end_added_at_run_time(spark):
    language = facts.Language("lines", lambda text: Node("file", 0, len(text), [(None, Node("identifier", 0, len(text)))]), {"identifier"}, {}, {})
    rulebook.register(language, ["ln"])
    try:
        with pytest.raises(rulebook.RuleError):
            rulebook.register(language, ["ln"])
        assert [f["target"] for f in facts.facts_of("lines", "abc")] == ["abc"]
        assert [r.external for r in rulebook.languages_table(spark).where("lang = 'lines'").collect()] == [True]
    finally:
        from quarry.sources.corpus import EXTENSIONS

        del facts.LANGUAGES["lines"], EXTENSIONS["lines"]


def test_profiles_leave_out_what_is_wrong():
    import yaml

    doc = yaml.safe_load("names: [identifier]\ncalls: {call_expression: [function, arguments]}\nwrites: {a: [b]}\nstatements: {x: 1}\nfolded: true\n")
    from quarry.sources import javascript

    language, warnings = facts.from_profile("other", javascript.parse, doc)
    assert language.calls == {"call_expression": ("function", "arguments")} and language.folded and language.dataflow and not language.writes and len(warnings) == 2
    bare, none = facts.from_profile("bare", javascript.parse, None)
    assert not bare.dataflow and not none
    rulebook.register(bare, ["bare"])
    try:
        rule = {"id": "t", "kind": "taint", "languages": ["bare"], "sources": [{"target": ["f"]}], "sinks": [{"target": ["f"]}]}
        assert rulebook.warnings_without_flow([rule]) == ["t: no data flow for bare"]
        from quarry.operators.dataflow import analyse

        assert analyse("a", "bare", facts.facts_of("bare", "f(f())"), [rule]) == ([], [], [])
    finally:
        from quarry.sources.corpus import EXTENSIONS

        del facts.LANGUAGES["bare"], EXTENSIONS["bare"]

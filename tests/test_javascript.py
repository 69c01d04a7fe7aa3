import random

import pytest

from quarry.operators.rules import pattern_findings
from quarry.plans import treequery
from quarry.sources import javascript

RULES = [
    {"id": "t.track", "severity": "info", "message": "track(${n})", "query": '(call_expression function: (identifier) @fn arguments: (arguments . (number) @n .) (#eq? @fn "track")) @finding'},
    {"id": "t.name", "severity": "low", "query": "(variable_declarator name: (identifier) @name value: (_)?) @finding", "filters": [{"capture": "name", "pattern": "^t"}, {"capture": "value", "equals": "x", "negate": True}]},
    {"id": "t.either", "severity": "low", "query": "(return_statement [(number) (string)] @v) @finding"},
]
CODE = """track(1); // expect t.track
track(1, 2); track("a");
const token = 3, other = 4; // expect t.name
let type; // expect t.name
function f(x) { return 1; } // expect t.either
function g(x) { return x; }
function h(x) { return "é"; } // expect t.either
"""


def test_rules_find_what_is_annotated(spark):
    files = spark.createDataFrame([("a.js", CODE)], "path string, text string")
    rows = pattern_findings(javascript.nodes(files), files, RULES).collect()
    want = {(n, line.split("expect ")[1].strip()) for n, line in enumerate(CODE.split("\n"), 1) if "// expect" in line}
    assert {(r.line, r.rule_id) for r in rows} == want
    assert {r.message for r in rows if r.rule_id == "t.track"} == {"track(1)"}


def test_positions_are_bytes(spark):
    files = spark.createDataFrame([("a.js", 'x("é");\n  y(1);')], "path string, text string")
    rows = {(r.kind, r.text): r for r in javascript.nodes(files).collect()}
    y = rows[("call_expression", "y(1)")]
    assert (y.start_line, y.start_col, y.start_byte) == (2, 3, 11)


def test_trees_are_nested_intervals():
    r = random.Random(1)
    parts = ["a", "(", ")", "{", "}", "[", "]", "`", "${", "'", "=>", "function ", "class ", ";", "\n", "/", "*", "//", ".", "...", ",", "=", "import ", "export ", "for", "in ", "é", "if", "try", "catch", " "]
    for _ in range(400):
        rows = list(javascript.rows("p", "".join(r.choice(parts) for _ in range(r.randint(0, 30)))))
        at = {x["id"]: x for x in rows}
        for x in rows[1:]:
            p = at[x["parent_id"]]
            assert p["start_byte"] <= x["start_byte"] <= x["end_byte"] <= p["end_byte"] and p["pre"] < x["pre"] and p["post"] > x["post"]
    for deep in ("(" * 3000, "[" * 3000 + "]" * 3000, "{" * 3000, "a" + ".b" * 3000):
        assert list(javascript.rows("p", deep))


def test_anchors_order_and_optional_children(spark):
    files = spark.createDataFrame([("a.js", "f(a, 1, b); f(1, a); f(a /* c */, 1); f();")], "path string, text string")
    nodes = treequery.prepared(javascript.nodes(files)).cache()
    count = lambda q: treequery.run(q, nodes).count()
    assert count("(arguments (identifier) @a (number) @n)") == 2
    assert count("(arguments . (identifier) @a . (number) @n)") == 2
    assert count("(arguments (number) @n . (identifier) @a .)") == 2
    assert count("(arguments (identifier) @a . (number) @n .)") == 1
    assert count("(arguments .) @none") == 1
    assert count("(arguments (number)? @n) @all") == 4
    assert count("(arguments [(number) (identifier)] @x)") == 7
    assert count('(arguments (_) @x (#not-match? @x "^[0-9]"))') == 5  # a comment is a node
    for bad in ("(a", "[(a)", "", "(a (#what? @x))", "a"):
        with pytest.raises(treequery.QueryError):
            treequery.run(bad, nodes)

import pytest

from quarry.plans import treequery
from quarry.sources import facts, javascript

CODE = "f(1, 2); f(); f(1, a); f(a, 1); f(/* n */ 1, 2, 3); g(1, 2);"


@pytest.fixture(scope="module")
def base(spark):
    files = spark.createDataFrame([("a.js", CODE)], "path string, text string")
    return treequery.prepared(javascript.nodes(files)).cache()


@pytest.mark.parametrize(
    "query, want",
    [
        ("(arguments . (number)* .) @a", ["()", "(/* n */ 1, 2, 3)", "(1, 2)", "(1, 2)"]),
        ("(arguments . (number)+ .) @a", ["(/* n */ 1, 2, 3)", "(1, 2)", "(1, 2)"]),
        ("(arguments . (number)* . (identifier) @x)", ["a", "a"]),
        ("(arguments (number)+ (identifier) @x)", ["a"]),
        ("(arguments (identifier) . (number)+ .) @a", ["(a, 1)"]),
        ("(arguments (number)* (identifier) @x)", ["a", "a"]),
        ("(arguments . (number) @n . (number)* .)", ["1", "1", "1"]),
        ("(arguments (number) @n)", ["1", "1", "1", "1", "1", "2", "2", "2", "3"]),
        ("(call_expression function: (identifier) @f arguments: (arguments .) (#eq? @f \"f\"))", ["f"]),
        ("[(number) (identifier)] @x (#any-of? @x \"a\" \"3\")", None),
    ],
)
def test_repetition_anchors_and_gaps(base, query, want):
    if want is None:
        with pytest.raises(treequery.QueryError):
            treequery.run(query, base).collect()
        return
    got = treequery.run(query, base)
    name = next(c for c in got.columns if c.startswith("c_"))
    assert sorted(r[0] for r in got.select(f"{name}.text").collect()) == sorted(want)


def test_deep_code_is_parsed_whole(spark):
    deep = "if (a) {" * 2000 + "debugger;" + "}" * 2000 + "f(" * 3000 + ")" * 3000
    files = spark.createDataFrame([("a.js", deep)], "path string, text string")
    kinds = {r.kind: r["count"] for r in javascript.nodes(files).groupBy("kind").count().collect()}
    assert kinds["debugger_statement"] == 1 and kinds["call_expression"] == 3000 and "ERROR" not in kinds


@pytest.mark.parametrize("lang, text, kinds", [
    ("go", 'package a\nimport ex "os/exec"\nfunc F(w W, r *R) { x := r.A(1); y, z = f(x), 2; c := &T{K: true}; go func() {}() }', {"import_spec", "function_declaration", "short_var_declaration", "assignment_statement", "keyed_element", "func_literal", "selector_expression"}),
    ("csharp", 'class A { [X] public async Task<int> F(string a, int b = 2) { var x = new T(a) { P = 1 }; try { G(x => x.Y); } catch (E e) { } return $"{a}"; } }', {"method_declaration", "parameter", "object_creation_expression", "lambda_expression", "catch_clause", "interpolated_string_expression"}),
    ("rust", 'use a::b as c; fn f(x: &str) -> R { let y = format!("{}", x); unsafe { *p }; c::d(&y)?; v.iter().map(|z| z.w()).sum() }', {"use_as_clause", "function_item", "let_declaration", "macro_invocation", "unsafe_block", "reference_expression", "closure_expression", "field_expression"}),
    ("pascal", "unit U; implementation procedure P(const A: string); begin X.Y := A; with Z do W(1); try Q; except end; end; end.", {"defProc", "declArg", "assignment", "exprDot", "exprCall", "with", "try", "kExcept", "kEnd"}),
    ("objectscript", 'Class A.B Extends C\n{\nMethod M(a As %String)\n{\n set x = ##class(D).E(a), ^g(1) = $zf(-1, "x")\n do ..F(.x) quit:a=1 $$$OK\n xecute "a"\n}\n}', {"method_definition", "set_argument", "class_method_call", "gvn", "system_defined_function", "relative_dot_method", "command_quit", "command_xecute"}),
])
def test_front_ends_make_nested_trees(spark, lang, text, kinds):
    rows = facts.nodes(spark.createDataFrame([("x", lang, text)], "path string, lang string, text string")).collect()
    at = {r.id: r for r in rows}
    assert kinds <= {r.kind for r in rows} and "ERROR" not in {r.kind for r in rows}
    for r in rows[1:]:
        p = at[r.parent_id]
        assert p.start_byte <= r.start_byte <= r.end_byte <= p.end_byte and p.pre < r.pre and p.post > r.post


def test_no_text_stops_a_front_end():
    import random

    r = random.Random(3)
    parts = ["(", ")", "{", "}", "[", "]", "<", ">", '"', "'", "`", ";", ":", ",", ".", "=", ":=", "=>", "|", "!", "&", "*", "#", "@", "$", "^", "..", "\n", " ", "é", "a", "B", "1", "func ", "fn ", "class ", "new ", "return ", "let ", "begin ", "end ", "try ", "except ", "set ", "do ", "quit ", "##class(", "$zf(", "import ", "use ", "if ", "for ", "catch "]
    for lang in facts.LANGUAGES:
        for _ in range(150):
            text = "".join(r.choice(parts) for _ in range(r.randint(0, 40)))
            for f in facts.facts_of(lang, text):
                assert 0 <= f["start"] <= f["end"] <= len(text.encode())

import pyarrow as pa
import pytest

from quarry.operators import dataflow, rulebook
from quarry.sources import facts

MODULE = "export function name(req) { return req.query.name; }\nexport function show(el, v) { el.innerHTML = v; }\n"
PAGE = "import {{ name, show as put }} from './{0}';\nfunction view(req, el) {{\n  el.innerHTML = name(req);\n  put(el, req.body.text);\n}}\n"
RULES = [r for r in rulebook.load()[0] if r["id"] == "js.xss.dom"]


@pytest.fixture(scope="module")
def files(spark):
    """Modules that are copies of each other, a page for each, a page of another language beside a module of its own."""
    rows = [(f"a/m{k}.js", "javascript", MODULE) for k in range(20)] + [(f"a/p{k}.js", "javascript", PAGE.format(f"m{k}")) for k in range(20)]
    return spark.createDataFrame([*rows, ("a/m3.ts", "typescript", MODULE), ("a/q.ts", "typescript", PAGE.format("m3")), ("a/none.js", "javascript", None), ("a/x.txt", "plain", "x")], "path string, lang string, text string").coalesce(1)


def test_links_are_made_of_imports_that_are_read_once(spark, files):
    """Hops from import to import don't read the facts of all files again."""
    done = dataflow.solved(facts.with_facts(files), RULES, ("facts",))
    linked = dataflow.links(done, dataflow.flat_summaries(done))
    plan = linked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2  # files are parsed and solved for their summaries, not once more for each hop
    got = {r.path: sorted(l.local for l in r.links) for r in linked.collect()}
    assert got == {p: ["name", "put"] for p in [*(f"a/p{k}.js" for k in range(20)), "a/q.ts"]}


def test_an_import_resolves_by_the_language_of_its_file(spark, files):
    filed = facts.with_facts(files)
    got = {(r.path, r.local): r.file for r in dataflow.resolved_imports(dataflow.imports(filed), filed.select("path")).collect()}
    assert got["a/p3.js", "put"] == "a/m3.js" and got["a/q.ts", "put"] == "a/m3.ts" and len(got) == 42


def test_texts_are_parsed_and_solved_in_one_step(spark, files):
    apart = dataflow.solved(facts.with_facts(files), RULES, ("facts",))
    together = dataflow.solved(files, RULES)
    assert together._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted(together.select(*apart.columns).collect()) == sorted(apart.collect()) and together.count() == 43
    one = {r.path: r for r in apart.collect()}
    alone = [dataflow.analyse(p, "javascript", facts.facts_of("javascript", t), RULES) for p, t in (("a/m7.js", MODULE), ("a/p7.js", PAGE.format("m7")))]
    for (found, summaries, verdicts), path in zip(alone, ("a/m7.js", "a/p7.js")):
        r = one[path].asDict(recursive=True)
        assert (r["found"], r["summaries"], r["verdicts"]) == (found, summaries, verdicts)


def test_a_worker_holds_few_facts_at_once(monkeypatch):
    """All files come, in order, in pieces of so many facts or of one file; copies are the same objects."""
    texts = [MODULE, "", PAGE.format("x"), MODULE, "// nothing", MODULE]
    want = [facts.facts_of("javascript", t) for t in texts]
    for most in (1, 20, 45, 4_000):
        monkeypatch.setattr(facts, "HELD", most)
        for pieces in (list(facts.parsed(["javascript"] * 6, texts)), list(facts.unpacked(pa.array(want, pa.list_(facts.ARROW)))), list(facts.unpacked(pa.array([[], *want, []], pa.list_(facts.ARROW)).slice(1, 6)))):
            assert [f for _, piece in pieces for f in piece] == want
            assert [at for at, _ in pieces] == [sum(len(p) for _, p in pieces[:k]) for k in range(len(pieces))]
        assert max(sum(map(len, p)) for _, p in pieces) <= max(most, max(map(len, want)))
    (_, held), = facts.parsed(["javascript"] * 6, texts)
    assert held[0] is held[3] is held[5]
    assert list(facts.parsed([], [])) == [] == list(facts.unpacked(pa.array([], pa.list_(facts.ARROW))))


def test_plain_values_are_those_of_arrow():
    kind = pa.list_(pa.struct([("s", pa.string()), ("i", pa.int32()), ("n", pa.null()), ("b", pa.bool_()), ("f", pa.float64()), ("l", pa.list_(pa.struct([("x", pa.int64()), ("y", pa.list_(pa.string()))])))]))
    one = {"s": "é", "i": 2**31 - 1, "n": None, "b": True, "f": 0.5, "l": [{"x": 2**53 + 1, "y": ["a", None]}, None, {"x": None, "y": None}]}
    rows = [[one, None], None, [], [dict.fromkeys(one), one | {"l": [], "i": None}], [one | {"s": ""}]]
    a = pa.array(rows, kind)
    for at in range(6):
        for n in range(6 - at):
            assert facts.plain(a.slice(at, n)) == a.slice(at, n).to_pylist()

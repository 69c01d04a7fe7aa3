import json

import pytest

from quarry.functions.scalars import glob_regex
from quarry.operators import evidence, reports, rulebook
from quarry.operators.findings import line_findings, suppress, with_fingerprints
from quarry.sources import corpus

RULES = [{"id": "t.todo", "severity": "low", "pattern": "TODO"}, {"id": "t.fix", "severity": "critical", "pattern": "FIX+ME", "unless": "XX"}]
FILES = [("b.go", "é TODO a\nTODO b\nTODO b\n\n"), ("a.js", "x FIXME\r\ny FIXXME TODO\r\n")]


@pytest.fixture(scope="module")
def found(spark):
    files = corpus.with_language(spark.createDataFrame([*FILES, ("c.none", "TODO")], "path string, text string"))
    return with_fingerprints(line_findings(files, RULES)).cache()


def test_findings_and_fingerprints(found):
    rows = {(r.path, r.line, r.rule_id): r for r in found.collect()}
    assert set(rows) == {("b.go", 1, "t.todo"), ("b.go", 2, "t.todo"), ("b.go", 3, "t.todo"), ("a.js", 1, "t.fix"), ("a.js", 2, "t.todo")}
    assert rows[("b.go", 1, "t.todo")].start_col == 4 and rows[("b.go", 3, "t.todo")].occurrence == 1
    prints = {r.fingerprint for r in rows.values()}
    assert len(prints) == 5 and all(len(p) == 32 for p in prints)
    assert suppress(found, found.select("fingerprint")).count() == 0


def test_sarif_json_and_text(spark, found):
    rules = [{"id": r["id"], "severity": r["severity"], "category": "quality", "kind": "pattern", "languages": [], "message": "m", "cwe": ["CWE-1"], "owasp": [], "nist": [], "tags": ["t"]} for r in RULES]
    doc = json.loads("".join(reports.sarif_lines(found, rulebook.table(spark, rules))))
    run = doc["runs"][0]
    ids = [r["id"] for r in run["tool"]["driver"]["rules"]]
    assert doc["version"] == "2.1.0" and ids == ["t.fix", "t.todo"] and len(run["results"]) == 5
    assert run["results"][0]["ruleId"] == "t.fix" and all(ids[r["ruleIndex"]] == r["ruleId"] for r in run["results"])
    assert run["tool"]["driver"]["rules"][0]["properties"]["tags"] == ["external/cwe/cwe-1", "t"] and run["results"][0]["locations"][0]["physicalLocation"]["region"]["startLine"] == 1
    unknown = json.loads("".join(reports.sarif_lines(found, rulebook.table(spark, rules[:1]))))["runs"][0]
    assert len(unknown["results"]) == 5 and unknown["tool"]["driver"]["rules"][0]["shortDescription"]["text"] == "t.fix"
    assert [json.loads(r.finding)["rule_id"] for r in reports.as_json(found).collect()][0] == "t.fix"
    text = list(reports.human(found))
    assert text[0] == "a.js" and text[-1] == "5 findings (1 critical, 4 low)"
    assert reports.format_of("TEXT") == "human"
    with pytest.raises(ValueError):
        reports.format_of("xml")


def test_evidence_is_strict_both_ways(spark):
    text = "TODO // expect t.todo\nok // expect-not t.todo\n# expect t.todo\nTODO\nTODO\nnone // expect t.todo\nTODO // expect-not t.todo\n"
    files = spark.createDataFrame([("a.js", text)], "path string, text string").selectExpr("*", "'x' AS lang")
    got = evidence.verify(files, line_findings(files, [{"id": "t.todo", "severity": "low", "pattern": "TODO"}])).first()
    assert (got.positives, got.negatives, got.tier) == (2, 1, "medium")
    assert list(got.failures) == ["a.js:5 unannotated", "a.js:6 missed", "a.js:7 unwanted"]


def test_folders_languages_and_globs(spark, tmp_path):
    for name in ("a.js", "sub/b.GO", "sub/c.txt", ".git/d.js", "sub/.e.js"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x\xff")
    files = corpus.read_folder(spark, str(tmp_path))
    assert {(r.path, r.lang) for r in files.collect()} == {("a.js", "javascript"), ("sub/b.GO", "go")}
    assert [r.path for r in corpus.scoped(files, include=["*.{js,GO}"], exclude=["sub*"]).collect()] == ["a.js"]
    assert corpus.stats(files, 1).first() == (2, 0, 2)
    assert glob_regex("a?[!b]*.x") == r"^a.[^b].*\.x$"
    with pytest.raises(ValueError):
        glob_regex("{a")


def test_changed_paths_are_those_of_git(tmp_path):
    import subprocess

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a").write_text("1")
    (tmp_path / "b").write_text("1")
    git("add", ".")
    git("commit", "-qm", "x")
    (tmp_path / "a").write_text("2")
    (tmp_path / "b").unlink()
    (tmp_path / "c").write_text("3")
    assert corpus.changed_paths(str(tmp_path), "HEAD") == ["a", "c"]

import json

import pytest

from quarry import scan, state
from quarry.operators import findings, reports
from quarry.operators.documents import Document, Section
from quarry.sources import deltas
from quarry.sources.deltas import DeltaLog
from quarry.sources.hadoop import Folder


@pytest.fixture(scope="module")
def remote(spark, tmp_path_factory):
    """A path that only Hadoop's file systems open: a mount table's."""
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.far.link./data", f"file://{tmp_path_factory.mktemp('far')}")
    return "viewfs://far/data"


def table(spark, rows):
    return spark.createDataFrame(rows, "path string, said string")


def known(log):
    df = log.read()
    return None if df is None else {r.path: r.said for r in df.collect()}


def test_newest_rows_win_and_tombstones_hide(spark, remote):
    log = DeltaLog(spark, f"{remote}/newest", ["path"], "r1")
    assert known(log) is None
    log.write(table(spark, [("a", "1"), ("b", "1"), (None, "n")]))
    log.write(table(spark, [("b", "2"), ("c", "2")]), table(spark, [("a", "")]).select("path"))
    assert known(log) == {"b": "2", "c": "2", None: "n"}
    log.write(table(spark, [("a", "3"), (None, "m")]))
    assert known(log) == {"a": "3", "b": "2", "c": "2", None: "m"}
    assert known(DeltaLog(spark, f"{remote}/newest", ["path"], "r2")) is None
    other = DeltaLog(spark, f"{remote}/newest", ["path"], "r2")
    other.write(table(spark, [("z", "9")]))
    assert known(other) == {"z": "9"} and known(log) is None
    assert log.clear() and not log.clear()
    empty = table(spark, []).where("false")
    log.write(empty)
    assert known(log) == {} and log.write(empty) == 0 and len(log.entries()) == 1
    log.write(table(spark, [("a", "1")]))
    assert known(log) == {"a": "1"}


def test_bytes_follow_what_changed_and_deltas_become_one(spark, tmp_path):
    log = DeltaLog(spark, f"file://{tmp_path}/log", ["path"], "r")
    first = log.write(table(spark, [(f"f{i}", f"{i * i:0200d}") for i in range(20_000)]))
    one = [log.write(table(spark, [(f"f{i}", "new")])) for i in range(5)]
    assert max(one) < first / 20
    assert len(log.entries()) == 6
    for i in range(5, 12):
        log.write(table(spark, [(f"f{i}", "new")]))
    assert len(log.entries()) < 8 and sum(e["whole"] for e in log.entries()) == 1
    got = known(log)
    assert len(got) == 20_000 and all(got[f"f{i}"] == "new" for i in range(12)) and got["f12"] != "new"


def test_readers_see_old_or_new(spark, tmp_path, monkeypatch):
    """A write that stops before its rename leaves what was known; one that meets another's entry takes the next number."""
    monkeypatch.setattr(deltas, "SHARE", 100)
    log = DeltaLog(spark, f"file://{tmp_path}/log", ["path"], "r")
    log.write(table(spark, [("a", "1")]))
    create = Folder.create
    seen = []

    def during(self, name, text, replace=False):
        seen.append(known(log))
        raise OSError("lost")

    monkeypatch.setattr(Folder, "create", during)
    with pytest.raises(OSError):
        log.write(table(spark, [("a", "2")]))
    assert seen == [{"a": "1"}] and known(log) == {"a": "1"}

    def raced(self, name, text, replace=False):
        monkeypatch.setattr(Folder, "create", create)
        assert create(self, name, json.dumps({"kind": "r", "whole": False, "folder": log.entries()[0]["folder"], "bytes": 1, "schema": log.entries()[0]["schema"]}))
        return create(self, name, text)

    monkeypatch.setattr(Folder, "create", raced)
    log.write(table(spark, [("a", "3")]))
    assert known(log) == {"a": "3"} and [e["number"] for e in log.entries()] == [1, 2, 3]
    (tmp_path / "log" / "log" / "0000000004.json").write_text("{ no json")
    assert known(log) is None


def test_a_scan_writes_what_changed(spark, tmp_path, remote):
    for i in range(40):
        (tmp_path / f"f{i}.js").write_text(f"function g{i}(req) {{ eval(req.query.x); debugger; }}\n" * 5)
    opts = scan.Options(root=str(tmp_path), state=f"{remote}/scan")
    rows = lambda r: sorted((x.path, x.rule_id, x.line) for x in r.findings.collect())
    sizes = []
    cold = rows(scan.scan(spark, opts))
    sizes.append(sum(v["bytes"] for v in state.info(opts.root, opts.state).values()))
    (tmp_path / "f3.js").write_text("debugger;\n")
    (tmp_path / "f4.js").unlink()
    warm = scan.scan(spark, opts)
    sizes.append(sum(v["bytes"] for v in state.info(opts.root, opts.state).values()))
    assert warm.stats["cached"] == 38 and warm.stats["summaries_reused"] == 38 and not (tmp_path / state.FOLDER).exists()
    assert rows(warm) == rows(scan.scan(spark, scan.Options(root=str(tmp_path), no_cache=True))) != cold
    assert sizes[1] - sizes[0] < sizes[0] / 2
    cache, _ = state.caches(spark, opts.state, scan.rulebook.rules_hash(warm.rules))
    assert {"f4.js", "f3.js"} & {r.path for r in cache.read().collect()} == {"f3.js"}


def test_documents_are_ordered_and_whole(spark, tmp_path):
    rows = spark.range(5000).selectExpr("5000 - id AS o", "to_json(struct(id)) AS line")
    doc = Document([Section('{"a": [', rows, ["o"], ","), Section('], "b": [', rows.where("o > 9999"), ["o"], ","), Section('], "c": [', None)], "]}")
    doc.write(str(tmp_path / "out.json"))
    got = json.loads((tmp_path / "out.json").read_text())
    assert [x["id"] for x in got["a"]] == list(range(4999, -1, -1)) and got["b"] == got["c"] == []
    assert json.loads("".join(doc.lines())) == got
    doc.publish(f"file://{tmp_path}/parts")
    manifest = json.loads((tmp_path / "parts" / "_manifest.json").read_text())
    text = "".join((tmp_path / "parts" / n).read_text() for n in manifest["sections"][0]["fragments"])
    assert json.loads("[" + text[1:] + "]") == got["a"]


def test_reports_gather_nothing(spark, tmp_path, monkeypatch):
    """Many findings: what comes to the driver is a row a severity, a rule, a fragment."""
    from pyspark.sql import DataFrame
    from pyspark.sql import functions as F

    n = 200_000
    made = spark.range(n).select(F.concat(F.lit("p"), (F.col("id") % 3).cast("string")).alias("path"), (F.col("id") + 1).cast("int").alias("line"), F.lit(1).alias("start_col"), F.lit("low").alias("severity"), F.lit(1).alias("severity_rank"), F.lit("r").alias("rule_id"), F.lit("x").alias("snippet"), F.col("id").cast("string").alias("fingerprint"))
    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda *a, **k: pytest.fail("findings reach the driver"))
    collect = DataFrame.collect

    def few(self):
        out = collect(self)
        assert len(out) < 100
        return out

    monkeypatch.setattr(DataFrame, "collect", few)
    reports.write(reports.json_document(made, {"n": n}), str(tmp_path / "a.json"))
    reports.write(reports.human_document(made), str(tmp_path / "a.txt"))
    state.write_baseline(tmp_path / "base.json", made)
    doc = json.loads((tmp_path / "a.json").read_text())
    assert len(doc["findings"]) == n and [f["path"] for f in doc["findings"][:: n // 3 + 1]] == ["p0", "p1", "p2"]
    text = (tmp_path / "a.txt").read_text().split("\n")
    assert [x for x in text if x.startswith("p")] == ["p0", "p1", "p2"] and text[-2] == f"{n} findings ({n} low)"
    base = state.baseline_table(spark, tmp_path / "base.json")
    assert base.count() == n and "LocalTableScan" not in base._jdf.queryExecution().optimizedPlan().toString()
    assert findings.suppress(made, base.where("fingerprint < '5'")).count() == made.where("fingerprint >= '5'").count()


def test_baselines_that_are_missing_or_spoilt_are_errors(spark, tmp_path):
    (tmp_path / "plain.json").write_text(json.dumps({"schema": 1, "updated": "t", "fingerprints": ["a", "b"]}, indent=1))
    assert {r[0] for r in state.baseline_table(spark, tmp_path / "plain.json").collect()} == {"a", "b"}
    assert state.baseline_info(spark, tmp_path / "plain.json") == {"fingerprints": 2, "updated": "t"}
    for text in ("{ no", '{"schema": 1}', '{"schema": 1, "updated": "t", "fingerprints": [\n"a"\n'):
        (tmp_path / "bad.json").write_text(text)
        with pytest.raises(state.StateError):
            state.baseline_table(spark, tmp_path / "bad.json")
    with pytest.raises(state.StateError):
        state.baseline_table(spark, tmp_path / "none.json")

"""The scan: files in, findings with fingerprints out, by pattern rules, data flow in files and between files, and caches."""

from __future__ import annotations

import re
import subprocess
import time
import tomllib
from dataclasses import dataclass, field, fields
from functools import reduce
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import state
from quarry.functions.scalars import glob_regex, message, severity_rank
from quarry.operators import dataflow, findings, rulebook
from quarry.operators.rules import pattern_findings
from quarry.sources import corpus, facts
from quarry.sources.store import materialised

CONFIG = "quarry.toml"
IGNORE_FILES = (".gitignore", ".ignore", ".quarryignore")


class ScanError(ValueError):
    pass


@dataclass
class Options:
    root: str = "."
    paths: list[str] = field(default_factory=list)
    diff_base: str | None = None
    rules: list[str] = field(default_factory=list)
    no_default_rules: bool = False
    only_rules: list[str] = field(default_factory=list)
    langs: list[str] = field(default_factory=list)
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    disable_rules: list[str] = field(default_factory=list)
    extensions: dict[str, str] = field(default_factory=dict)
    baseline: str | None = None
    fail_on: str = "high"
    max_file_size: int = corpus.MAX_BYTES
    no_cache: bool = False
    no_ignore: bool = False
    state: str | None = None


@dataclass
class Result:
    findings: DataFrame
    stats: dict
    rules: list[dict]
    warnings: list[str]
    errors: DataFrame

    def fails(self, threshold: str) -> bool:
        return threshold != "never" and bool(findings.exceeds(self.findings, SEVERITY_ORDER[threshold]).first()["fails"])


SEVERITY_ORDER = {"info": 0, "note": 0, "low": 1, "medium": 2, "warning": 2, "high": 3, "error": 3, "critical": 4}


def configured(root: str, path: str | None = None) -> dict:
    """What the configuration says: the file named, or the one at the root, which may be missing. Unknown keys are an error."""
    file = Path(path) if path else Path(root) / CONFIG
    if not file.exists():
        if path:
            raise ScanError(f"no configuration at {path}")
        return {}
    try:
        doc = tomllib.loads(file.read_text(encoding="utf-8"))
    except tomllib.TOMLDecodeError as e:
        raise ScanError(f"{file}: {e}") from e
    known = {"rules", "no_default_rules", "exclude", "include", "fail_on", "max_file_size", "disable_rules"}
    own = doc.get("scan", {})
    if set(own) - known:
        raise ScanError(f"{file}: unknown keys {sorted(set(own) - known)}")
    return own | {"extensions": {k.lower().lstrip("."): v for k, v in doc.get("extensions", {}).items()}}


def options(config: dict, **given) -> Options:
    """Lists of the configuration and of the call are joined; other values of the call come first, then the configuration's."""
    out = {}
    for f in fields(Options):
        a, b = config.get(f.name), given.get(f.name)
        if isinstance(a, list) or isinstance(b, list):
            out[f.name] = [*(a or []), *(b or [])]
        elif b is not None:
            out[f.name] = b
        elif a is not None:
            out[f.name] = a
    return Options(**out)


def repository(path: str) -> str:
    """The top of the repository around a folder, else the folder."""
    done = subprocess.run(["git", "-C", path, "rev-parse", "--show-toplevel"], capture_output=True, text=True)
    return done.stdout.strip() if done.returncode == 0 else str(Path(path).resolve())


def inside(root: str, paths: list[str]) -> list[str]:
    """Paths relative to the root; one that is missing or lies outside is an error."""
    top, out = Path(root).resolve(), []
    for p in paths:
        full = Path(p).resolve() if Path(p).is_absolute() else (top / p).resolve()
        if not full.exists() or (full != top and top not in full.parents):
            raise ScanError(f"{p} is not inside {root}")
        out.append("" if full == top else full.relative_to(top).as_posix())
    return sorted(set(out))


def under(path: Column, prefixes: list[str]) -> Column:
    """Whether a path is one of these, or below one; "" is everything."""
    return reduce(lambda a, b: a | b, [F.lit(True) if p == "" else (path == p) | path.startswith(p + "/") for p in prefixes], F.lit(False))


def ignore_rules(root: str, own_only: bool = False) -> list[tuple[str, bool]]:
    """(pattern, whether it ignores) of all ignore files, from the top down; a later match wins. Own ignore files always count."""
    out: list[tuple[str, bool]] = []
    names = IGNORE_FILES[-1:] if own_only else IGNORE_FILES
    top = Path(root)
    found = sorted((f for n in names for f in top.rglob(n) if ".git" not in f.parts[:-1]), key=lambda f: (len(f.parts), str(f)))
    for f in found:
        base = "" if f.parent == top else f.parent.relative_to(top).as_posix() + "/"
        out += ignore_patterns(base, f.read_text(encoding="utf-8", errors="replace").splitlines())
    return out


def ignore_patterns(base: str, lines: list[str]) -> list[tuple[str, bool]]:
    """What the lines of an ignore file in a folder (base, with its slash) say: patterns of paths, and whether they ignore or keep."""
    out = []
    for line in lines:
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        keep, line = line.startswith("!"), line.removeprefix("!")
        tail = "/.*" if line.endswith("/") else "(/.*)?"
        line = line.rstrip("/")
        anchored = "/" in line
        parts = [".*" if p == "**" else glob_regex(p)[1:-1].replace(".*", "[^/]*") for p in line.lstrip("/").split("/")]
        out.append((f"^{re.escape(base)}{'' if anchored else '(.*/)?'}{'/'.join(parts)}{tail}$".replace("/.*/", "/(.*/)?"), not keep))
    return out


def ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    return reduce(lambda so_far, r: F.when(path.rlike(r[0]), F.lit(r[1])).otherwise(so_far), rules, F.lit(False))


def pattern_rows(filed: DataFrame, rules: list[dict]) -> DataFrame:
    """Findings of rules that test facts: one scan of the facts, all tests in it."""
    flat = facts.facts(filed)
    hits = []
    for r in rules:
        ok = reduce(lambda a, b: a | b, [rulebook.column(p, F.col) for p in r["when"]])
        at = next((p["arg"].get("at", 0) for p in r["when"] if "arg" in p), 0)
        said = message(r["message"], {"name": F.col("name"), "target": F.col("target"), "text": F.col("text"), "value": F.col("value.text"), "arg": F.try_element_at("args", F.lit(at + 1))["text"]})
        hits.append(F.when(F.col("lang").isin(*r["languages"]) & ok, F.struct(F.lit(r["id"]).alias("rule_id"), said.alias("message"))))
    if not hits:
        return flat.where("false").select("path", "lang", F.lit("").alias("rule_id"), F.lit("").alias("message"), "start", "end", "line", "col", "end_line", "end_col", "snippet")
    out = flat.withColumn("hit", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())))
    return out.select("path", "lang", "hit.rule_id", "hit.message", "start", "end", "line", "col", "end_line", "end_col", "snippet")


def completed(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings with what their rules say, one for each span, with fingerprints. Rules are a few hundred rows."""
    rows = findings.one_each(rows, ["path", "rule_id", "start", "end"], ["line"])
    out = rows.join(F.broadcast(rules.select("rule_id", "severity", "category", "cwe", "owasp", "nist", "tags", "fix", "precision")), "rule_id", "left")
    out = out.withColumn("severity_rank", severity_rank(F.col("severity"))).withColumnRenamed("col", "start_col")
    return findings.with_fingerprints(out)


def scan(spark: SparkSession, opts: Options) -> Result:
    began = time.monotonic()
    rules, warnings = rulebook.load(opts.rules, not opts.no_default_rules, opts.disable_rules)
    read = corpus.read_folder(spark, opts.root, opts.extensions)
    read = read.where(~F.col("path").startswith(state.FOLDER + "/"))
    read = read.where(~ignored(F.col("path"), ignore_rules(opts.root, opts.no_ignore)))
    if opts.paths:
        read = read.where(under(F.col("path"), inside(opts.root, opts.paths)))
    if opts.diff_base:
        read = corpus.only_paths(read, spark.createDataFrame([(p,) for p in corpus.changed_paths(opts.root, opts.diff_base)], "path string"))
    return analyse(spark, corpus.scoped(read, opts.include, opts.exclude, opts.langs), rules, opts, warnings, began)


def analyse(spark: SparkSession, files: DataFrame, rules: list[dict], opts: Options, warnings: list[str] = (), began: float | None = None) -> Result:
    """Scans files (path, lang, size, text, content_hash, and read_error where a file couldn't be read)."""
    began = time.monotonic() if began is None else began
    if "read_error" not in files.columns:
        files = files.withColumn("read_error", F.lit(None).cast("string"))
    counted = files.agg(F.count("*").alias("considered"), F.count_if(F.col("size") > opts.max_file_size).alias("skipped"), F.count_if(F.col("read_error").isNotNull()).alias("unread")).first()
    small = files.where((F.col("size") <= opts.max_file_size) & F.col("read_error").isNull())
    key = rulebook.rules_hash(rules)
    cache, store = state.caches(spark, state.folder(opts.root, opts.state), key)
    old = None if opts.no_cache else cache.read()
    kept = None if opts.no_cache else store.read()

    # facts and what a file says by itself: from the store where content and rules are the same
    small = materialised(small.withColumn("key", state.summary_key(F.col("content_hash"), key)).select("path", "lang", "text", "content_hash", "key"))
    fresh = small if kept is None else small.join(kept.select("path", "key"), ["path", "key"], "left_anti")
    # parsed and solved in one pass; what goes along isn't joined again
    own = dataflow.solved(fresh, rules, ("content_hash", "key"))
    entries = own.select("path", "lang", "content_hash", "key", "facts", "found", "summaries")
    reused = 0
    if kept is not None:
        again = kept.join(small.select("path", "key"), ["path", "key"], "left_semi").select(*entries.columns)
        reused = again.count()
        entries = entries.unionByName(again)
    entries = materialised(entries)

    # files among each other
    linked = materialised(dataflow.links(entries, dataflow.flat_summaries(entries)))
    everything = materialised(entries.select("path", "content_hash").join(linked.select("path", "link_hash"), "path", "left").withColumn("link_hash", F.coalesce("link_hash", F.lit(""))))
    hits = everything.where("false").select("path") if old is None else everything.join(old.select("path", "content_hash", "link_hash"), ["path", "content_hash", "link_hash"], "left_semi").select("path")
    hits = materialised(hits)
    todo = entries if old is None else entries.join(hits, "path", "left_anti")
    with_links = dataflow.solved(todo.join(linked.select("path", "links"), "path"), rules).select("path", "lang", "found")
    flows = todo.join(linked.select("path"), "path", "left_anti").select("path", "lang", "found").unionByName(with_links)
    flows = flows.select("path", "lang", F.explode("found").alias("f")).select("path", "lang", "f.*")
    says = F.create_map(*[F.lit(x) for r in rules for x in (r["id"], r["message"])]) if rules else None
    flows = flows.select("path", "lang", "rule_id", (says[F.col("rule_id")] if rules else F.lit("")).alias("message"), "start", "end", "line", "col", F.col("line").alias("end_line"), F.col("col").alias("end_col"), "snippet", "trace")
    no_trace = F.array().cast(f"array<{dataflow.STEP}>")
    found = pattern_rows(todo, [r for r in rules if r.get("when")]).withColumn("trace", no_trace).unionByName(flows)
    trees = [r for r in rules if r.get("query")]
    if trees:
        langs = sorted({l for r in trees for l in r["languages"]})
        texts = todo.join(small.select("path", "text"), "path").where(F.col("lang").isin(langs)).select("path", "lang", "text")
        by_tree = pattern_findings(facts.nodes(texts), texts, trees).join(texts.select("path", "lang"), "path")
        by_tree = by_tree.where(reduce(lambda a, b: a | b, [(F.col("rule_id") == r["id"]) & F.col("lang").isin(*r["languages"]) for r in trees]))
        found = found.unionByName(by_tree.select("path", "lang", "rule_id", "message", F.col("start_byte").alias("start"), F.col("end_byte").alias("end"), "line", F.col("start_col").alias("col"), "end_line", "end_col", "snippet", no_trace.alias("trace")))
    raw = found
    if old is not None:
        raw = raw.unionByName(old.join(hits, "path", "left_semi").select(F.explode("rows").alias("r")).select("r.*").select(*found.columns))
    raw = materialised(raw)
    if not opts.no_cache:
        # what this run looked at anew is a delta; what it didn't look at stays known, unless it looked at everything
        rows = raw.groupBy("path").agg(F.collect_list(F.struct(*raw.columns)).alias("rows"))
        keyed = everything.join(hits, "path", "left_anti").join(rows, "path", "left").withColumn("rows", F.coalesce("rows", F.array().cast(rows.schema["rows"].dataType)))
        whole = not (opts.paths or opts.diff_base or opts.include or opts.exclude or opts.langs)
        lost = lambda known: known.select("path").join(everything.select("path"), "path", "left_anti") if whole and known is not None else None
        new = entries if kept is None else entries.join(kept.select("path", "key"), ["path", "key"], "left_anti")
        try:
            cache.write(keyed, lost(old))
            store.write(new, lost(kept))
        except (OSError, Py4JError, PySparkException) as e:
            warnings = [*warnings, f"what was found couldn't be kept: {e}"]
    out = completed(raw, rulebook.table(spark, rules))
    if opts.only_rules:
        out = out.where(F.col("rule_id").isin(*opts.only_rules))
    out, suppressed = materialised(out), 0
    if opts.baseline:
        known = state.baseline_table(spark, opts.baseline)
        new = materialised(findings.suppress(out, known))
        suppressed = out.count() - new.count()
        out = new
    cached = hits.count()
    stats = {"considered": counted["considered"], "scanned": everything.count() - cached, "cached": cached, "skipped": counted["skipped"], "summarised": entries.count() - reused, "summaries_reused": reused, "suppressed": suppressed, "findings": out.count(), "ms": int((time.monotonic() - began) * 1000)}
    return Result(findings.report_order(out), stats, rules, list(warnings), files.where("read_error IS NOT NULL").select("path", "read_error"))


def explain(path: str, lang: str, text: str, rules: list[dict]) -> dict:
    """What the engine makes of one file by itself: functions with their lines, calls with what they are, each sink's verdict."""
    known = facts.facts_of(lang, text)
    _, summaries, verdicts = dataflow.analyse(path, lang, known, rules)
    calls = [{"line": f["line"], "target": f["target"], "is": described(f)} for f in sorted(known, key=lambda f: f["start"]) if f["fact"] in ("call", "new")]
    return {"path": path, "language": lang, "functions": [{"name": f["name"], "from": f["line"], "to": f["end_line"]} for f in known if f["fact"] == "function" and f["name"]], "calls": calls, "sinks": verdicts, "summaries": [{"rule": s["rule_id"], "function": s["function"], "returns_source": s["source"] is not None, "returns_parameters": s["params"], "parameters_reach_sinks": sorted({k["param"] for k in s["sinks"]})} for s in summaries]}


def described(f: dict) -> str:
    """What a call is, in words."""
    kind = f["resolution"]
    return f"{f['symbol']} of {f['module']}" if kind == "external" else f"function {f['symbol']} of this file" if kind == "local" else f"{f['symbol']} of {f['receiver']}" if kind == "member" else "not resolved"

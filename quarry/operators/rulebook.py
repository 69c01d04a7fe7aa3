"""Rules as data: YAML documents of parts, each a test of one fact, compiled to column predicates and to plain predicates.

A rule has id, severity, languages, message and either `when` (parts, any of which is a finding), `query` (a tree pattern with
filters) or `sources` and `sinks` (and `sanitizers`): parts whose `take` says which span counts. A part may test fact, name,
target, receiver, module, kind and text of a value or an argument; a test is a list of strings or a pattern between slashes.
`resolved` tests what a call or read is by imports, whatever it is called in the file.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable
from functools import lru_cache, reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.scalars import SEVERITIES
from quarry.plans import treequery
from quarry.sources.facts import LANGUAGES

BUILTIN = Path(__file__).resolve().parent.parent / "rules"
TESTS = ("name", "target", "receiver", "module", "text")
PART = {*TESTS, "fact", "value", "arg", "args", "take", "label", "resolved"}
FACTS = ("call", "new", "macro", "assign", "read", "return", "statement", "import", "function", "param", "type")
RESOLVED = {"module", "member_of", "name", "path", "arg_index", "match_unresolved"}
PATTERN_ONLY, TAINT_ONLY = ("when", "query", "filters"), ("sources", "sinks", "sanitizers")
#: Raised when what rules mean changes, so that what was found before isn't taken for what would be found now.
REVISION = 2


class RuleError(ValueError):
    pass


def documents(path: str | Path) -> list[tuple[str, dict]]:
    """(file, document) of a YAML file, or of all in a folder and below, sorted; what lies under tests/ and evidence files are
    no rules. Text that is no YAML is an error."""
    import yaml

    p = Path(path)
    if not p.exists():
        raise RuleError(f"no rules at {p}")
    files = [p] if p.is_file() else sorted(f for f in p.rglob("*.y*ml") if "tests" not in f.relative_to(p).parts and f.stem != "evidence")
    out = []
    for f in files:
        try:
            out.append((str(f), yaml.safe_load(f.read_text(encoding="utf-8")) or {}))
        except yaml.YAMLError as e:
            raise RuleError(f"{f}: {e}") from e
    return out


def load(paths: Iterable[str | Path] = (), builtin: bool = True, disabled: Iterable[str] = ()) -> tuple[list[dict], list[str]]:
    """Rules and warnings. Later rules replace those of the same id, with a warning; one that can't run is left out, with a
    warning. Disabled rules are taken out before anything is compiled."""
    rules: dict[str, dict] = {}
    warnings = []
    for path in [*([BUILTIN] if builtin else []), *paths]:
        for name, doc in documents(path):
            sets = doc.get("sets", {})
            for raw in doc.get("rules", []):
                try:
                    rule = expanded(raw, sets, doc.get("languages"))
                    validate(rule)
                except (RuleError, treequery.QueryError, re.error, TypeError, AttributeError) as e:
                    warnings.append(f"{name}: {raw.get('id') if isinstance(raw, dict) else raw}: {e}")
                    continue
                if rule["id"] in rules:
                    warnings.append(f"{rule['id']}: replaced by {name}")
                rules[rule["id"]] = rule
    warnings += warnings_without_flow(list(rules.values()))
    gone = set(disabled)
    return [rules[k] for k in sorted(rules) if k not in gone], shown(warnings, verbose=True)


def shown(warnings: list[str], verbose: bool = False, most: int = 8) -> list[str]:
    """Distinct warnings, the first few unless verbose."""
    distinct = list(dict.fromkeys(warnings))
    return distinct if verbose else distinct[:most]


def expanded(raw: dict, sets: dict, languages: list | None) -> dict:
    """A rule with named sets of parts put in, and tags spelt out."""
    rule = {"severity": "medium", "category": "security", "languages": languages or [], "message": raw.get("id", "")} | raw
    for role in ("when", *TAINT_ONLY):
        parts = []
        for p in rule.get(role, []):
            if isinstance(p, str):
                if p not in sets:
                    raise RuleError(f"no set {p}")
                parts += sets[p]
            else:
                parts.append(p)
        if role in rule:
            rule[role] = parts
    rule["kind"] = "taint" if rule.get("sources") or rule.get("sinks") else "pattern"
    rule["cwe"] = [f"CWE-{c}" if isinstance(c, int) else c for c in rule.get("cwe", [])]
    rule["owasp"] = [o if ":" in o else f"{o}:2021" for o in rule.get("owasp", [])]
    rule["nist"], rule["tags"] = rule.get("nist", []), rule.get("tags", [])
    return rule


def validate(rule: dict) -> None:
    """Raises RuleError where a rule can't run: it lacks an id, a known severity or language; has parts of the other kind; a part
    or filter has unknown tests; a pattern doesn't compile; a measured precision is claimed."""
    if not rule.get("id"):
        raise RuleError("no id")
    if rule["severity"] not in SEVERITIES:
        raise RuleError(f"unknown severity {rule['severity']}")
    if rule["category"] not in ("security", "quality"):
        raise RuleError(f"unknown category {rule['category']}")
    if "precision" in rule:
        raise RuleError("precision is measured, not written")
    if not rule["languages"] or set(rule["languages"]) - set(LANGUAGES):
        raise RuleError(f"languages {rule['languages']}")
    if rule["kind"] == "taint":
        if any(rule.get(k) for k in PATTERN_ONLY) or not rule.get("sources") or not rule.get("sinks"):
            raise RuleError("a taint rule has sources and sinks, and no when, query or filters")
    elif bool(rule.get("when")) == bool(rule.get("query")) or rule.get("sanitizers"):
        raise RuleError("a pattern rule has either when or query, and no sanitizers")
    if rule.get("query"):
        treequery.parse(rule["query"])
    for f in rule.get("filters", []):
        if not f.get("capture") or not {"pattern", "equals", "any_of"} & set(f):
            raise RuleError("a filter names a capture and a test")
        re.compile(f.get("pattern", ""))
    for role in ("when", *TAINT_ONLY):
        for p in rule.get(role, []):
            if set(p) - PART or p.get("fact", "call") not in FACTS:
                raise RuleError(f"unknown test in {p}")
            if "resolved" in p and (set(p["resolved"]) - RESOLVED or set(p) & set(TESTS) or not ({"name", "path"} & set(p["resolved"]))):
                raise RuleError(f"resolved stands alone and names something: {p}")
            for key in TESTS:
                if isinstance(p.get(key), str):
                    re.compile(_pattern(p[key]))
            taken(p)


def _pattern(test: str) -> str:
    if len(test) < 2 or test[0] != "/" or test[-1] != "/":
        raise RuleError(f"{test!r} is no list and no /pattern/")
    return test[1:-1]


def taken(part: dict) -> tuple[str, int]:
    """What of a fact counts: ("self", 0), ("value", 0), ("arg", n) or ("args", n): all arguments from n on."""
    m = re.fullmatch(r"(self|value|arg|args)(?: (\d+))?", part.get("take", "self"))
    if not m:
        raise RuleError(f"take: {part.get('take')}")
    return m[1], int(m[2] or 0)


@lru_cache
def _compiled(test: str) -> re.Pattern:
    return re.compile(_pattern(test))


# -- tests of a fact, as columns and as plain values -------------------------------------------------------------------------
def column(part: dict, f) -> Column:
    """Whether a fact (a struct column, or a function from name to column) passes a part."""
    tests = [f("fact") == part.get("fact", "call")]
    one = lambda test, c: F.coalesce(c.rlike(_pattern(test)) if isinstance(test, str) else c.isin(*test), F.lit(False))
    tests += [one(part[k], f(k)) for k in TESTS if k in part]
    spans = [(part["value"], f("value"))] if "value" in part else []
    spans += [(part["arg"], F.try_element_at(f("args"), F.lit(part["arg"].get("at", 0) + 1)))] if "arg" in part else []
    for want, span in spans:
        tests += [one(want["kind"], span["kind"])] if "kind" in want else []
        tests += [~one(want["not_kind"], span["kind"])] if "not_kind" in want else []
        tests += [one(want["text"], span["text"])] if "text" in want else []
        tests += [~one(want["not_text"], span["text"])] if "not_text" in want else []
        tests.append(span.isNotNull())
    if "args" in part:
        tests.append(F.size(f("args")) >= part["args"])
    if "resolved" in part:
        tests.append(identity(part["resolved"], f))
    return reduce(lambda a, b: a & b, tests)


def identity(want: dict, f) -> Column:
    """Whether a call or read is what a matcher names: of a module by imports, a member of a name, or, where allowed, anything so
    called that no import explains."""
    ok = F.lit(True)
    if "name" in want:
        ok &= f("symbol") == want["name"]
    if "module" in want:
        ok &= (f("module") == want["module"]) | (F.coalesce(f("module"), F.lit("")) == "") & (f("receiver") == want["module"])
    elif "member_of" in want:
        ok &= f("base") == want["member_of"]
    elif "name" in want and not want.get("match_unresolved"):
        ok &= f("resolution") != "unresolved"
    if want.get("path"):
        ok &= F.slice(F.split(f("target"), r"\."), 2, len(want["path"])) == F.array(*[F.lit(p) for p in want["path"]])
    return F.coalesce(ok, F.lit(False))


def holds(part: dict, f: dict) -> bool:
    """As column(), for a fact as a dict."""
    if f["fact"] != part.get("fact", "call"):
        return False
    one = lambda test, x: x is not None and (_compiled(test).search(x) is not None if isinstance(test, str) else x in test)
    if any(k in part and not one(part[k], f[k]) for k in TESTS) or len(f["args"]) < part.get("args", 0):
        return False
    spans = [(part["value"], f["value"])] if "value" in part else []
    if "arg" in part:
        at = part["arg"].get("at", 0)
        spans.append((part["arg"], f["args"][at] if at < len(f["args"]) else None))
    for want, span in spans:
        if span is None or ("kind" in want and not one(want["kind"], span["kind"])) or ("not_kind" in want and one(want["not_kind"], span["kind"])):
            return False
        if ("text" in want and not one(want["text"], span["text"])) or ("not_text" in want and one(want["not_text"], span["text"])):
            return False
    r = part.get("resolved")
    if r:
        if "name" in r and f["symbol"] != r["name"]:
            return False
        if "module" in r:
            if r["module"] != (f["module"] or f["receiver"]):
                return False
        elif "member_of" in r:
            if f["base"] != r["member_of"]:
                return False
        elif "name" in r and f["resolution"] == "unresolved" and not r.get("match_unresolved"):
            return False
        if r.get("path") and f["target"].split(".")[1 : 1 + len(r["path"])] != r["path"]:
            return False
    return True


def spans_of(part: dict, f: dict) -> list[tuple[int, int]]:
    kind, n = taken(part)
    if "resolved" in part and "take" not in part and f["fact"] == "call":
        at = part["resolved"].get("arg_index")
        picked = f["args"] if at is None else f["args"][at : at + 1]
        return [(a["start"], a["end"]) for a in picked]
    if kind == "self":
        return [(f["start"], f["end"])]
    if kind == "value":
        return [(f["value"]["start"], f["value"]["end"])] if f["value"] else []
    return [(a["start"], a["end"]) for a in (f["args"][n : n + 1] if kind == "arg" else f["args"][n:])]


# -- rules as a table --------------------------------------------------------------------------------------------------------
def table(spark: SparkSession, rules: list[dict], evidence: dict | None = None) -> DataFrame:
    """A row a rule, in order of ids. Precision is what evidence (rule to positives and negatives; None:
    what is recorded beside the rules) says, else low."""
    from .measures import precision_tier

    known = recorded() if evidence is None else evidence
    rows = [(r["id"], r.get("name") or r["id"], r["severity"], r["category"], r["kind"], list(r["languages"]), r["message"], r.get("fix"), r.get("description"), r["cwe"], r["owasp"], r["nist"], r["tags"], *known.get(r["id"], (None, None))) for r in sorted(rules, key=lambda r: r["id"])]
    out = spark.createDataFrame(rows, "rule_id string, name string, severity string, category string, kind string, languages array<string>, message string, fix string, description string, cwe array<string>, owasp array<string>, nist array<string>, tags array<string>, positives int, negatives int")
    return out.withColumn("precision", F.coalesce(F.when(F.col("positives").isNotNull(), precision_tier(F.col("positives"), F.col("negatives"))), F.lit("low")))


def recorded() -> dict:
    """The evidence that is kept beside the rules."""
    from .evidence import read

    path = BUILTIN / "evidence.yaml"
    return read(str(path)) if path.exists() else {}


def listing(rules: DataFrame, verbose: bool = False) -> DataFrame:
    """What a list of rules shows."""
    more = ["message", "cwe", "owasp", "nist", "tags"] if verbose else []
    return rules.select("rule_id", "severity", "kind", "category", F.array_join("languages", ",").alias("languages"), *more).orderBy("rule_id")


def live(rules: DataFrame, languages: DataFrame) -> DataFrame:
    """Ids of rules that run for at least one of the languages (lang)."""
    return by_language(rules).join(F.broadcast(languages.select("lang")), "lang", "left_semi").select("rule_id").distinct()


def by_language(rules: DataFrame) -> DataFrame:
    """A row for each rule and each of its languages."""
    return rules.withColumn("lang", F.explode("languages"))


def rules_hash(rules: list[dict]) -> str:
    """A digest of all that rules say, whatever their order, with the revision of what they mean."""
    return hashlib.sha256(json.dumps([REVISION, sorted((r["id"], json.dumps(r, sort_keys=True)) for r in rules)]).encode()).hexdigest()


def languages_table(spark: SparkSession) -> DataFrame:
    """lang, name, extensions, external, dataflow: what a list of languages shows."""
    from quarry.sources.corpus import EXTENSIONS

    #: What languages are called.
    names = {"javascript": "JavaScript", "typescript": "TypeScript", "tsx": "TSX", "csharp": "C#", "go": "Go", "rust": "Rust", "pascal": "Pascal", "objectscript": "ObjectScript"}
    rows = [(k, names.get(k, k), list(EXTENSIONS.get(k, ())), k not in names, l.dataflow) for k, l in LANGUAGES.items()]
    return spark.createDataFrame(rows, "lang string, name string, extensions array<string>, external boolean, dataflow boolean").orderBy("lang")


def warnings_without_flow(rules: list[dict]) -> list[str]:
    """Taint rules of languages that have no profile for data flow can't run there."""
    return [f"{r['id']}: no data flow for {lang}" for r in rules if r["kind"] == "taint" for lang in r["languages"] if not LANGUAGES[lang].dataflow]


def register(language, extensions: Iterable[str]) -> None:
    """Adds a front-end at run time: a Language whose parse makes trees. A name that is taken is an error."""
    from quarry.sources.corpus import EXTENSIONS

    if language.name in LANGUAGES:
        raise RuleError(f"language {language.name} is there already")
    LANGUAGES[language.name] = language
    EXTENSIONS[language.name] = tuple(e.lower().lstrip(".") for e in extensions)

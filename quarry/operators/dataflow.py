"""Taint over the facts of files: a bounded fixpoint per file and rule, function summaries, links between files, verdicts.

Facts of a file lie in one row, so the fixpoint needs no shuffle. Summaries and imports are relations: files are linked by joins,
and only files that a link reaches are solved again.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.scalars import normalize_join, parent_dir
from quarry.sources.facts import ARROW, FACTS, LANGUAGES, parsed, plain, texts, unpacked
from quarry.sources.store import materialised

from . import flow
from .rulebook import holds, spans_of

#: Passes over the assignments, rounds of call summaries, levels of callers that a parameter is followed to, fields of a path.
PASSES, ROUNDS, LEVELS, FIELDS = 16, 3, 3, 3
ROLES = (("source", "sources"), ("sink", "sinks"), ("sanitizer", "sanitizers"))


@lru_cache(1 << 14)
def access_path(target: str) -> tuple[str, tuple]:
    """Base and up to FIELDS fields of a plain chain; of any other its first name."""
    parts = target.split(".")
    if all(re.fullmatch(r"[%^]?[^\W\d][\w$]*|[$][\w$]*", p) for p in parts):
        return parts[0], tuple(parts[1 : 1 + FIELDS])
    first = re.match(r"[%^]?[\w$]+", target)
    return (first[0] if first else ""), ()


class Structure:
    """What all rules share of one file."""

    def __init__(self, facts: list[dict], lang: str):
        self.kinds: dict = {}
        for f in facts:
            self.kinds.setdefault(f["fact"], []).append(f)
        of = lambda kind: self.kinds.get(kind, [])
        fold = str.lower if lang == "pascal" else (lambda x: x)
        functions = sorted(of("function"), key=lambda f: (f["start"], -f["end"]))
        self.scopes = [{"start": -1, "end": 1 << 60, "name": None}, *functions]
        self.parent, open_ = [-1], [0]
        for k, s in enumerate(functions, 1):
            while len(open_) > 1 and self.scopes[open_[-1]]["end"] < s["end"]:
                open_.pop()
            self.parent.append(open_[-1])
            open_.append(k)
        self.by_start = {s["start"]: k for k, s in enumerate(self.scopes)}
        shown = {f["line"]: f["snippet"] for f in facts}
        self.lines = {f["start"]: f for f in facts}
        for f in facts:
            for s in [*f["args"], *([f["value"]] if f["value"] else [])]:
                self.lines.setdefault(s["start"], {"line": s["line"], "col": s["col"], "snippet": shown.get(s["line"], f["snippet"]), "start": s["start"]})
        self.reads = sorted(({**f, "path": access_path(fold(f["target"]))} for f in of("read")), key=lambda f: f["start"])
        self.read_at = [f["start"] for f in self.reads]
        self.assigns = sorted(({**f, "path": access_path(fold(f["target"]))} for f in of("assign") if f["target"] and f["value"]), key=lambda f: f["param"])
        self.returns = [(f["value"]["start"], f["value"]["end"], f["scope"]) for f in of("return") if f["value"]]
        if lang == "pascal":
            self.returns += [(f["value"]["start"], f["value"]["end"], f["scope"]) for f in self.assigns if f["name"] == "Result"]
        own = lambda f: "." not in f["target"] or lang == "objectscript"
        self.calls = sorted(({**f} for f in of("call") if own(f) and f["module"] not in ("object", "class", "system") and f["name"]), key=lambda f: f["start"])
        self.call_at = [f["start"] for f in self.calls]
        self.params: dict = {}
        for f in of("param"):
            self.params.setdefault(self.by_start.get(f["scope"], 0), []).append((f["param"], fold(f["name"]), f["start"]))
        for f in [*self.reads, *self.assigns, *self.calls]:
            f["in"] = self.by_start.get(f["scope"], 0)

    def scope(self, start: int) -> int:
        return self.by_start.get(start, 0)

    def named(self, s: int) -> int:
        while s > 0 and not self.scopes[s]["name"]:
            s = self.parent[s]
        return s

    def within(self, starts: list[int], facts: list[dict], a: int, b: int) -> Iterator[dict]:
        k = bisect_left(starts, a)
        while k < len(facts) and starts[k] <= b:
            if facts[k]["end"] <= b:
                yield facts[k]
            k += 1


class Solver:
    """One rule in one file. An origin is ("s", place), ("x", place) for what a linked call brings, or ("p", scope, index);
    the state maps (scope, base) to fields to origins with the smallest place of writing, and the steps to it."""

    def __init__(self, structure: Structure, rule: dict, links: dict | None = None):
        self.t, self.rule, self.links = structure, rule, links or {}
        spans: dict = {role: {} for role, _ in ROLES}
        for role, key in ROLES:
            for part in rule.get(key, []):
                for f in structure.kinds.get(part.get("fact", "call"), ()):
                    if holds(part, f):
                        for s in spans_of(part, f):
                            spans[role].setdefault(s, part.get("label", role))
        self.sources, self.sinks = (sorted((a, b, label) for (a, b), label in spans[k].items()) for k in ("source", "sink"))
        self.source_at = [s[0] for s in self.sources]
        self.clean = sorted(spans["sanitizer"])
        self.state: dict = {}
        self.call_taint: dict = {}

    def applies(self) -> bool:
        from_ = self.sources or self.t.params or self.links
        return bool(from_ and (self.sinks or any(l["sinks"] for l in self.links.values())))

    def cleaned(self, a: int, b: int) -> bool:
        return any(s <= a and b <= e for s, e in self.clean if s <= a)

    def origins(self, a: int, b: int) -> dict:
        """What flows into an expression, with the steps to it."""
        out: dict = {}
        k = bisect_left(self.source_at, a)
        while k < len(self.sources) and self.sources[k][0] <= b:
            s, e, label = self.sources[k]
            if e <= b and not self.cleaned(s, e):
                out.setdefault(("s", s), [(f"source: {label}", s)])
            k += 1
        for r in self.t.within(self.t.read_at, self.t.reads, a, b):
            cells = None
            base, fields = r["path"]
            at = s = r["in"]
            while s >= 0:
                cells = self.state.get((s, base))
                if cells and not self.cleaned(r["start"], r["end"]):
                    for other, held in cells.items():
                        n = min(len(fields), len(other))
                        if fields[:n] == other[:n]:
                            for origin, (write, steps) in held.items():
                                if s != at or write < r["start"]:
                                    out.setdefault(origin, steps)
                s = self.t.parent[s]
        for c in self.t.within(self.t.call_at, self.t.calls, a, b):
            taint = self.call_taint.get(c["start"])
            if taint and not self.cleaned(c["start"], c["end"]):
                for origin, steps in taint.items():
                    out.setdefault(origin, [*steps, (f"returned by {c['name']}", c["start"])])
        return out

    def solve(self) -> Solver:
        t = self.t
        for s, params in t.params.items():
            for k, name, place in params:
                self.state.setdefault((s, name), {}).setdefault((), {})[("p", s, k)] = (-1, [(f"parameter {name}", place)])
        for _ in range(ROUNDS):
            for _ in range(PASSES):
                grew = False
                for a in t.assigns:
                    found = self.origins(a["value"]["start"], a["value"]["end"])
                    if found:
                        base, fields = a["path"]
                        cell = self.state.setdefault((a["in"], base), {}).setdefault(fields, {})
                        for origin, steps in found.items():
                            if origin not in cell:
                                cell[origin] = (a["param"], [*steps, (f"assigned to {a['target']}", a["param"])])
                                grew = True
                if not grew:
                    break
            self.summary = self.summarised()
            if not self.applied():
                break
        return self

    def summarised(self) -> dict:
        """Function name to origins of what it returns: same-named functions are one, the first witness stays."""
        out: dict = {}
        for a, b, scope in self.t.returns:
            s = self.t.named(self.t.scope(scope))
            if s:
                for origin, steps in self.origins(a, b).items():
                    if origin[0] != "p" or origin[1] == s:
                        out.setdefault(self.t.scopes[s]["name"], {}).setdefault(origin, steps)
        return out

    def applied(self) -> bool:
        """Calls that gain taint from summaries: of this file first, then of linked ones. A call is tainted once."""
        gained = False
        for c in self.t.calls:
            if c["start"] in self.call_taint:
                continue
            got: dict = {}
            for origin, steps in self.summary.get(c["name"], {}).items():
                if origin[0] != "p":
                    got.setdefault(origin, steps)
                elif origin[2] < len(c["args"]):
                    arg = c["args"][origin[2]]
                    for o, w in self.origins(arg["start"], arg["end"]).items():
                        got.setdefault(o, w)
            if not got and c["name"] in self.links:
                link = self.links[c["name"]]
                if link["source"] is not None:
                    got[("x", c["start"])] = [(s["label"], s) for s in link["source"]]
                else:
                    for k in link["params"]:
                        if k < len(c["args"]):
                            got = self.origins(c["args"][k]["start"], c["args"][k]["end"])
                            if got:
                                break
            if got:
                self.call_taint[c["start"]], gained = got, True
        return gained

    def callers(self, origin: tuple, level: int = 0) -> list | None:
        """Steps from a source to a parameter, through up to LEVELS callers of its function."""
        name = self.t.scopes[origin[1]]["name"]
        if level >= LEVELS or not name:
            return None
        for c in self.t.calls:
            if c["name"] == name and origin[2] < len(c["args"]):
                found = self.origins(c["args"][origin[2]]["start"], c["args"][origin[2]]["end"])
                for o in sorted(found):
                    way = found[o] if o[0] != "p" else self.callers(o, level + 1)
                    if way:
                        return [*way, (f"passed to {name}", c["start"])]
        return None

    def reaches(self, a: int, b: int) -> tuple[str, list | None]:
        """The verdict on a sink and, where something reaches it, the steps."""
        found = self.origins(a, b)
        way = next((found[o] for o in sorted(found, key=lambda o: (o[0] == "p", o)) if o[0] != "p"), None)
        if way:
            return "source reaches sink", way
        for o in sorted(o for o in found if o[0] == "p"):
            way = self.callers(o)
            if way:
                return "caller passes a source", way + found[o]
        if found:
            return "parameter without a tainted caller", None
        return ("sanitised" if any(a <= s and e <= b for s, e in self.clean) or self.cleaned(a, b) else "nothing reaches it"), None

    def step(self, label: str, at) -> dict:
        if isinstance(at, dict):
            return at
        f = self.t.lines.get(at)
        return {"label": label, "line": f["line"] if f else None, "col": f["col"] if f else None, "snippet": f["snippet"] if f else None, "file": None}

    def trace(self, steps: list, end: tuple[str, int]) -> list[dict]:
        """Steps with lines and snippets; one that says the same as the one before it is left out."""
        out: list[dict] = []
        for label, at in [*steps, end]:
            s = self.step(label, at)
            if not out or (out[-1]["line"], out[-1]["label"], out[-1]["file"]) != (s["line"], s["label"], s["file"]):
                out.append(s)
        return out

    def spot(self, start: int) -> dict:
        return self.t.lines.get(start) or next((f for f in sorted(self.t.lines.values(), key=lambda f: -f["start"]) if f["start"] <= start), {"line": 1, "col": 1, "snippet": ""})

    def report(self) -> list[dict]:
        out = []
        for a, b, label in self.sinks:
            verdict, way = self.reaches(a, b)
            if way:
                out.append(self.found(a, b, self.trace(way, (f"sink: {label}", a))))
        for c in self.t.calls:
            for k, rule_id, tail in self.links.get(c["name"], {"sinks": ()})["sinks"]:
                if rule_id == self.rule["id"] and k < len(c["args"]):
                    a, b = c["args"][k]["start"], c["args"][k]["end"]
                    verdict, way = self.reaches(a, b)
                    if way and not any(o["start"] == a and o["end"] == b for o in out):
                        out.append(self.found(a, b, self.trace(way, (f"passed to {c['name']}", a)) + tail))
        return out

    def found(self, a: int, b: int, trace: list[dict]) -> dict:
        f = self.spot(a)
        return {"rule_id": self.rule["id"], "start": a, "end": b, "line": f["line"], "col": f["col"], "snippet": f["snippet"], "trace": trace}

    def portable(self, path: str) -> dict:
        """function to (source steps or null, returned parameters, parameters that reach sinks), steps with the file they are in."""
        own = lambda steps: [s if s["file"] else s | {"file": path} for s in steps]
        out: dict = {}
        entry = lambda name: out.setdefault(name, {"source": None, "params": set(), "sinks": []})
        for name, held in self.summary.items():
            e = entry(name)
            first = min((o for o in held if o[0] != "p"), default=None)
            if first is not None:
                e["source"] = own(self.trace(held[first][:-1], held[first][-1]) if held[first] else [])
            e["params"] |= {o[2] for o in held if o[0] == "p"}
        for a, b, label in self.sinks:
            for o, steps in sorted(self.origins(a, b).items()):
                if o[0] == "p" and self.t.scopes[o[1]]["name"]:
                    entry(self.t.scopes[o[1]]["name"])["sinks"].append((o[2], own(self.trace(steps, (f"sink: {label}", a)))))
        return {k: v for k, v in out.items() if v["source"] is not None or v["params"] or v["sinks"]}


STEP = "struct<label:string,line:int,col:int,snippet:string,file:string>"
FINDING = f"struct<rule_id:string,start:int,end:int,line:int,col:int,snippet:string,trace:array<{STEP}>>"
SUMMARY = f"struct<rule_id:string,function:string,source:array<{STEP}>,params:array<int>,sinks:array<struct<param:int,steps:array<{STEP}>>>>"
LINK = f"struct<local:string,rule_id:string,source:array<{STEP}>,params:array<int>,sinks:array<struct<param:int,steps:array<{STEP}>>>>"
VERDICT = "struct<rule_id:string,start:int,end:int,line:int,snippet:string,verdict:string>"
_STEP = pa.struct([("label", pa.string()), ("line", pa.int32()), ("col", pa.int32()), ("snippet", pa.string()), ("file", pa.string())])
_SINKS = pa.list_(pa.struct([("param", pa.int32()), ("steps", pa.list_(_STEP))]))
_FINDING = pa.struct([("rule_id", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("line", pa.int32()), ("col", pa.int32()), ("snippet", pa.string()), ("trace", pa.list_(_STEP))])
_SUMMARY = pa.struct([("rule_id", pa.string()), ("function", pa.string()), ("source", pa.list_(_STEP)), ("params", pa.list_(pa.int32())), ("sinks", _SINKS)])
_VERDICT = pa.struct([("rule_id", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("line", pa.int32()), ("snippet", pa.string()), ("verdict", pa.string())])


def analyse(path: str, lang: str, facts: list[dict], rules: list[dict], links: list[dict] | None = None) -> tuple[list, list, list]:
    """Findings, summaries and verdicts of one file under all taint rules of its language; without links by itself."""
    found, summaries, verdicts, structure = [], [], [], None
    for rule in rules if LANGUAGES[lang].dataflow else []:
        if rule["kind"] != "taint" or lang not in rule["languages"]:
            continue
        known: dict = {}
        for l in links or []:
            if l["rule_id"] == rule["id"]:
                known[l["local"]] = {"source": l["source"], "params": l["params"] or [], "sinks": [(s["param"], rule["id"], s["steps"]) for s in l["sinks"] or []]}
        structure = structure or Structure(facts, lang)
        solver = Solver(structure, rule, known)
        if not (solver.sources or solver.sinks or known):
            continue
        solver.solve()
        if solver.applies():
            found += solver.report()
        for name, s in sorted(solver.portable(path).items()):
            summaries.append({"rule_id": rule["id"], "function": name, "source": s["source"], "params": sorted(s["params"]), "sinks": [{"param": k, "steps": steps} for k, steps in s["sinks"]]})
        for a, b, _ in solver.sinks:
            f = solver.spot(a)
            verdicts.append({"rule_id": rule["id"], "start": a, "end": b, "line": f["line"], "snippet": f["snippet"], "verdict": solver.reaches(a, b)[0]})
    return found, summaries, verdicts


def solved(filed: DataFrame, rules: list[dict], keep: tuple = ()) -> DataFrame:
    """path, lang, found, summaries, verdicts (and the columns to keep) of files (path, lang, facts, and links where files are
    linked). Files with text instead of facts are parsed here, in the same step, and come with their facts. Narrow: no shuffle."""
    linked, fresh = "links" in filed.columns, "facts" not in filed.columns
    filed = texts(filed, keep) if fresh else filed
    columns = ["path", "lang", "text" if fresh else "facts", *(["links"] if linked else [])]
    array = lambda kind: T.ArrayType(T._parse_datatype_string(kind))
    made = [T.StructField(n, t) for n, t in (("path", T.StringType()), ("lang", T.StringType()), ("found", array(FINDING)), ("summaries", array(SUMMARY)), ("verdicts", array(VERDICT)))]
    made += [T.StructField("facts", array(FACTS))] if fresh else []
    more, out = [c for c in keep if c not in columns], [*(f.name for f in made), *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            paths, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, facts in parsed(langs, batch.column(2).to_pylist()) if fresh else unpacked(batch.column(2)):
                part = batch.slice(i, len(facts))
                links = plain(part.column(3)) if linked else [None] * len(facts)
                done = [analyse(*of, rules, known) for *of, known in zip(paths[i:], langs[i:], facts, links)]
                arrays = [pa.array(column, pa.list_(kind)) for column, kind in zip(zip(*done), (_FINDING, _SUMMARY, _VERDICT))]
                arrays += [pa.array(facts, pa.list_(ARROW))] if fresh else []
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *arrays, *(part.column(names.index(c)) for c in keep)], out)

    return filed.select(*columns, *more).mapInArrow(run, T.StructType([*made, *filed.select(*keep).schema.fields]))


# -- files among each other ----------------------------------------------------------------------------------------------------
#: What a path in an import may leave out, by language.
ENDINGS = {"javascript": (["js", "mjs", "cjs", "jsx"], ["index.js", "index.mjs", "index.jsx"]), "typescript": (["ts", "mts", "cts", "tsx", "js"], ["index.ts", "index.tsx", "index.js"]), "tsx": (["tsx", "ts", "js"], ["index.tsx", "index.ts", "index.js"])}


def imports(filed: DataFrame) -> DataFrame:
    """path, lang, local, module, name of each import; a whole module has the name *."""
    own = F.filter("facts", lambda f: f["fact"] == "import")
    return filed.select("path", "lang", F.explode(own).alias("i")).select("path", "lang", F.col("i.name").alias("local"), "i.module", F.coalesce(F.when(F.col("i.receiver") == "", F.lit(None)).otherwise(F.col("i.receiver")), F.lit("*")).alias("name"))


def resolved_imports(imported: DataFrame, files: DataFrame) -> DataFrame:
    """imports of relative paths with the file that each names: as it is, with each ending, as a folder with an index; the first."""
    near = imported.where(F.col("module").rlike(r"^\.\.?(/|$)") & F.col("lang").isin([*ENDINGS])).withColumn("target", normalize_join(parent_dir(F.col("path")), F.col("module")))
    own = near.select(F.struct("path", "lang", "local", "module", "name").alias("import_id"), "target").distinct()
    options = F.coalesce(*[F.when(F.col("import_id.lang") == lang, flow.ways(*left_out)) for lang, left_out in ENDINGS.items()])
    hit = flow.first_of(own, files, options)
    return hit.select("import_id.path", "import_id.local", "import_id.module", "import_id.name", F.col("path").alias("file"))


def by_symbol(imported: DataFrame, declared: DataFrame) -> DataFrame:
    """imports of languages that import by name, with the files that declare it: the whole name or its last part. declared: file, name."""
    last = F.element_at(F.split("module", r"[/:.]+"), -1)
    keys = imported.where(~F.col("lang").isin([*ENDINGS])).select("path", "local", "module", "name", F.explode(F.array_distinct(F.array("module", last))).alias("key"))
    return keys.join(declared.select("file", F.col("name").alias("key")), "key").drop("key").distinct()


def name_parts(name):
    return F.filter(F.split(name, r"[/:.]+"), lambda p: p != "")


def by_longest_suffix(imported: DataFrame, declared: DataFrame, salts: int = 16) -> DataFrame:
    """module, suffix, files, file of each distinct module that imports name: the longest end of its parts that files declare (file,
    name), how many do, and which where one does. A name that many files declare is one class with a count, not a pair for each
    file; the files of a class are `declared` itself. Names meet once each: an end that very many modules share is dealt to `salts`
    keys, which costs the names so many rows."""
    classes = declared.select("file", F.array_join(name_parts(F.col("name")), ".").alias("suffix")).where("suffix <> ''").groupBy("suffix").agg(F.countDistinct("file").alias("files"), F.min("file").alias("file"))
    parts = name_parts(F.col("module"))
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    wanted = imported.select("module").distinct().where(F.size(parts) > 0).select("module", F.explode(ends).alias("suffix")).withColumn("salt", F.pmod(F.xxhash64("module"), F.lit(salts)))
    met = wanted.join(classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["suffix", "salt"])
    best = met.groupBy("module").agg(F.max_by(F.struct("suffix", "files", "file"), F.length("suffix")).alias("b"))
    return best.select("module", "b.suffix", "b.files", F.when(F.col("b.files") == 1, F.col("b.file")).alias("file"))


def links(filed: DataFrame, summaries: DataFrame) -> DataFrame:
    """path, links: what each file's imports bring it. summaries: file, rule_id, function, source, params, sinks. An import that
    names what its file imports itself is followed to where it is from, at most four files on; the farthest wins."""
    found = materialised(resolved_imports(imports(filed), filed.select("path")).select("path", "local", "name", "file"))
    again = found.select(F.col("path").alias("src"), F.col("local").alias("name"), F.col("file").alias("dst"), F.col("name").alias("other"))
    hops = found.select("path", "local", "name", "file", F.lit(0).alias("hop"))
    level = hops
    for h in range(1, 4):
        e = again.select(F.col("src").alias("file"), F.col("name"), "dst", "other")
        level = level.join(e, ["file", "name"]).select("path", "local", F.col("other").alias("name"), F.col("dst").alias("file"), F.lit(h).alias("hop"))
        hops = hops.unionByName(level)
    known = summaries.select("file", F.col("function").alias("name"), "rule_id", "source", "params", "sinks")
    hit = hops.join(known, ["file", "name"]).where("file <> path")
    best = Window.partitionBy("path", "local", "rule_id").orderBy(F.desc("hop"), "file")
    hit = hit.withColumn("nth", F.row_number().over(best)).where("nth = 1")
    return hit.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("local", "rule_id", "source", "params", "sinks"))).alias("links"), F.sha2(F.array_join(F.array_sort(F.collect_set(F.concat_ws("\x1f", "file", "name", F.to_json(F.struct("source", "params", "sinks"))))), "\n"), 256).alias("link_hash"))


def flat_summaries(done: DataFrame) -> DataFrame:
    return done.select(F.col("path").alias("file"), F.explode("summaries").alias("s")).select("file", "s.*")

"""Taint over a whole corpus as relations: where origins come to, call by call, and why each sink is or isn't reported.

Places are cells of (scope, base, fields); a cell holds origins, each with the least place that wrote it there. What reads see is
found by semi-naive rounds: each joins only what the round before added, and nothing is held by file, so one huge file is as many
rows as it has facts. All steps are joins and aggregates over stored tables; `dataflow` gives the same verdicts file by file, with
the steps of each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources import facts
from quarry.sources.facts import LANGUAGES
from quarry.sources.store import bucketed, materialised

from . import flow, intervals
from .rulebook import column, taken

#: Rounds of assignments, rounds of calls, levels of callers, fields of a path.
PASSES, ROUNDS, LEVELS, FIELDS = 64, 3, 3, 3
ROLES = (("source", "sources"), ("sink", "sinks"), ("sanitizer", "sanitizers"))
ORIGIN = "struct<kind:string,at:int,k:int>"
CELL = ["path", "rule", "scope", "base", "fields"]
EVER = 2**62


# -- assignments ---------------------------------------------------------------------------------------------------------------
def place() -> Column:
    """path, scope, base and _k (key, longer) as one text that no others have."""
    return F.to_json(F.array(F.col("path").cast("string"), F.col("scope").cast("string"), F.col("base"), F.col("_k.longer").cast("string"), F.to_json("_k.key")))


def seen_at(reads: DataFrame, around: DataFrame) -> DataFrame:
    """reads (path, read, scope, base, fields, at) under all keys that equality finds their cells by: in their own scope what is
    written before them, in those around it (path, child, ancestor) all; fields that begin theirs, or that theirs begin."""
    up = reads.join(around.withColumnRenamed("child", "scope"), ["path", "scope"]).select("path", "read", F.col("ancestor").alias("scope"), "base", "fields", F.lit(EVER).alias("before"))
    all_ = reads.select("path", "read", "scope", "base", "fields", F.col("at").cast("long").alias("before")).unionByName(up)
    begins = F.transform(F.sequence(F.lit(0), F.size("fields")), lambda n: F.struct(F.slice("fields", F.lit(1), n).alias("key"), F.lit(False).alias("longer")))
    keys = F.concat(begins, F.array(F.struct(F.col("fields").alias("key"), F.lit(True).alias("longer"))))
    return all_.withColumn("_k", F.explode(keys)).select(place().alias("place"), "path", "read", "before")


def keyed(cells: DataFrame) -> DataFrame:
    """cells under the keys that seen_at gives reads: their fields, and, as `longer`, what begins them."""
    shorter = F.transform(F.sequence(F.lit(0), F.size("fields")), lambda n: F.struct(F.slice("fields", F.lit(1), n).alias("key"), (n < F.size("fields")).alias("longer")))
    return cells.withColumn("_k", F.explode(shorter)).select(place().alias("place"), "rule", "origin", "at")


class Spread:
    """Origins on their way through assignments: what cells hold and reads see, grown by what is put in.

    reads: path, read, scope, base, fields, at; assigns: path, read (within the value), scope, base, fields, at of what is written;
    around: path, child, ancestor of scopes; cleaned: path, rule, read of reads that a sanitizer holds.
    """

    def __init__(self, reads: DataFrame, assigns: DataFrame, around: DataFrame, cleaned: DataFrame | None = None):
        self.keys, self.assigns, self.cleaned = bucketed(seen_at(reads, around), "place"), bucketed(assigns.distinct(), "path", "read"), cleaned
        self.cells: list[DataFrame] = []
        self.seen: list[DataFrame] = []

    @staticmethod
    def _all(parts: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, parts)

    def held(self) -> DataFrame:
        """path, rule, scope, base, fields, origin, at: each cell's origins with their least write."""
        return self._all(self.cells).groupBy(*CELL, "origin").agg(F.min("at").alias("at"))

    def of_reads(self) -> DataFrame:
        """path, rule, read, origin of all that reads see."""
        return self._all(self.seen)

    def grow(self, put: DataFrame, passes: int = PASSES) -> Spread:
        """Puts cells in (path, rule, scope, base, fields, origin, at) and follows them until nothing is new, `passes` at most. A cell
        is new where it lacks the origin or has it from a later write; a read where it lacks the origin. Deltas are tables of their
        own, so what is written follows what is new; reads and assignments lie in buckets, so what is shuffled does too."""
        for _ in range(passes):
            put = put.groupBy(*CELL, "origin").agg(F.min(F.col("at").cast("long")).alias("at"))
            if self.cells:
                old = self.held().withColumnRenamed("at", "was")
                put = put.join(old, [*CELL, "origin"], "left").where(F.col("was").isNull() | (F.col("at") < F.col("was"))).drop("was")
            put = materialised(put)
            self.cells.append(put)
            met = keyed(put).join(self.keys, "place").where(F.col("at") < F.col("before")).select("path", "rule", "read", "origin").distinct()
            if self.cleaned is not None:
                met = met.join(self.cleaned, ["path", "rule", "read"], "left_anti")
            if self.seen:
                met = met.join(self.of_reads(), ["path", "rule", "read", "origin"], "left_anti")
            new = materialised(met)
            self.seen.append(new)
            if new.isEmpty():
                break
            put = new.join(self.assigns, ["path", "read"]).select(*CELL, "origin", "at")
        return self


# -- facts as relations ---------------------------------------------------------------------------------------------------------
def path_of(target: Column) -> tuple[Column, Column]:
    """Base and up to FIELDS fields of a plain chain; of any other its first name and none."""
    parts = F.split(target, r"\.", -1)
    plain = F.forall(parts, lambda p: p.rlike(r"(?U)^(?:[%^]?[^\W\d][\w$]*|[$][\w$]*)$"))
    first = F.regexp_extract(target, r"(?U)^[%^]?[\w$]+", 0)
    return F.when(plain, parts[0]).otherwise(first), F.when(plain, F.slice(parts, 2, FIELDS)).otherwise(F.array().cast("array<string>"))


def _spans(part: dict) -> Column:
    """The spans of a fact that count for a part."""
    kind, n = taken(part)
    span = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))
    args = F.coalesce(F.transform("args", span), F.array().cast("array<struct<start:int,end:int>>"))
    if "resolved" in part and "take" not in part and part.get("fact", "call") == "call":
        at = part["resolved"].get("arg_index")
        return args if at is None else F.slice(args, at + 1, 1)
    if kind == "self":
        return F.array(F.struct("start", "end"))
    if kind == "value":
        return F.filter(F.array(F.when(F.col("value").isNotNull(), span(F.col("value")))), lambda s: s.isNotNull())
    return F.slice(args, n + 1, 1) if kind == "arg" else F.slice(args, n + 1, 1 << 30)


def role_spans(flat: DataFrame, rules: list[dict]) -> DataFrame:
    """path, rule, role, s, e: what taint rules count as sources, sinks and sanitizers, in one scan of the facts."""
    hits = []
    for r in rules:
        own = F.col("lang").isin(*r["languages"])
        for role, key in ROLES:
            for part in r.get(key) or []:
                hits.append(F.when(own & F.coalesce(column(part, F.col), F.lit(False)), F.struct(F.lit(r["id"]).alias("rule"), F.lit(role).alias("role"), _spans(part).alias("spans"))))
    found = flat.withColumn("hit", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull()))).select("path", "hit.rule", "hit.role", F.explode("hit.spans").alias("s"))
    return found.select("path", "rule", "role", F.col("s.start").cast("long").alias("s"), F.col("s.end").cast("long").alias("e")).distinct()


class Relations:
    """The facts of files (path, lang, facts) as what taint joins: each written once."""

    def __init__(self, filed: DataFrame, rules: list[dict]):
        flat = materialised(facts.facts(filed.select("path", "lang", "facts")))
        of = lambda kind: flat.where(F.col("fact") == kind)
        fold = lambda c: F.when(F.col("lang") == "pascal", F.lower(c)).otherwise(c)
        spans = materialised(role_spans(flat, rules))
        self.active = materialised(spans.where("role <> 'sanitizer'").select("path", "rule").distinct())
        role = lambda name: spans.where(F.col("role") == name).join(self.active, ["path", "rule"], "left_semi").drop("role")
        self.sinks, self.clean = role("sink"), role("sanitizer")

        # scopes: -1 is the file; of functions that start together the innermost is meant
        functions = of("function").groupBy("path", F.col("start").alias("scope")).agg(F.min(F.struct("end", "name")).alias("f")).select("path", "scope", F.col("f.end").alias("end"), F.nullif("f.name", F.lit("")).alias("name"))
        self.functions = materialised(functions)
        inner = self.functions.select("path", F.col("scope").alias("child"), F.col("scope").alias("ps"), F.col("end").alias("pe"))
        held = intervals.enclosing(inner, self.functions.select("path", F.col("scope").alias("ancestor"), F.col("scope").alias("s"), F.col("end").alias("e")), "path", "child", "ancestor")
        around = held.where("child <> ancestor").select("path", "child", "ancestor").unionByName(self.functions.select("path", F.col("scope").alias("child"), F.lit(-1).alias("ancestor")))
        self.around = materialised(around)
        named = self.functions.where("name IS NOT NULL").select("path", F.col("scope").alias("ancestor"), "name")
        self_too = self.around.unionByName(self.functions.select("path", F.col("scope").alias("child"), F.col("scope").alias("ancestor")))
        self.named = materialised(self_too.join(named, ["path", "ancestor"]).groupBy("path", F.col("child").alias("scope")).agg(F.max(F.struct("ancestor", "name")).alias("f")).select("path", "scope", F.col("f.ancestor").alias("owner"), "f.name"))
        self.names = named.select("path", F.col("ancestor").alias("scope"), "name")

        def scoped(rows: DataFrame) -> DataFrame:
            """rows with the scope that they are in."""
            known = self.functions.select("path", "scope", F.col("scope").alias("_s"))
            return rows.join(known, ["path", "scope"], "left").withColumn("scope", F.coalesce("_s", F.lit(-1))).drop("_s")

        def placed(rows: DataFrame) -> DataFrame:
            base, fields = path_of(fold(F.col("target")))
            return scoped(rows.withColumns({"base": base, "fields": fields}))

        span_id = lambda a, b: (F.shiftleft(F.col(a).cast("long"), 32) + F.col(b).cast("long"))
        self.reads = materialised(placed(of("read")).select("path", span_id("start", "end").alias("read"), "scope", "base", "fields", F.col("start").alias("at"), F.col("start").alias("ps"), F.col("end").alias("pe")).dropDuplicates(["path", "read"]))
        assigns = materialised(placed(of("assign").where("target <> '' AND value IS NOT NULL")).select("path", "lang", "name", "scope", "base", "fields", F.col("param").alias("at"), F.col("value.start").cast("long").alias("s"), F.col("value.end").cast("long").alias("e"), "start"))
        own = (~F.coalesce(F.col("target"), F.lit("")).contains(".") | (F.col("lang") == "objectscript")) & ~F.coalesce(F.col("module").isin("object", "class", "system"), F.lit(False)) & (F.coalesce("name", F.lit("")) != "")
        calls = of("call").where(own)
        self.calls = materialised(scoped(calls).select("path", span_id("start", "end").alias("call"), "name", "scope", F.col("start").alias("ps"), F.col("end").alias("pe")).dropDuplicates(["path", "call"]))
        self.args = materialised(calls.select("path", span_id("start", "end").alias("call"), "name", F.posexplode("args").alias("k", "a")).select("path", "call", "name", "k", F.col("a.start").cast("long").alias("s"), F.col("a.end").cast("long").alias("e")))
        returns = of("return").where("value IS NOT NULL").select("path", F.col("value.start").cast("long").alias("s"), F.col("value.end").cast("long").alias("e"), "scope")
        results = assigns.where("lang = 'pascal' AND name = 'Result'").select("path", "s", "e", "scope")
        self.returns = materialised(scoped(returns).select("path", "s", "e", "scope").unionByName(results).join(self.named, ["path", "scope"]).select("path", "s", "e", "owner", "name").distinct())
        params = scoped(of("param").where("name IS NOT NULL")).select("path", "scope", F.col("param").alias("k"), fold(F.col("name")).alias("base"))
        none = F.array().cast("array<string>")
        self.params = params.join(self.active, "path").select("path", "rule", "scope", "base", none.alias("fields"), F.struct(F.lit("p").alias("kind"), F.col("scope").alias("at"), F.col("k")).cast(ORIGIN).alias("origin"), F.lit(-1).alias("at"))

        # expressions are spans: what is in them is found once
        ends = ["path", "s", "e"]
        exprs = materialised(assigns.select(*ends).unionByName(self.args.select(*ends)).unionByName(self.returns.select(*ends)).unionByName(self.sinks.select(*ends)).distinct())
        inside = lambda points, spans_, key="path": intervals.enclosing(points, spans_, key, "", "")
        self.reads_in = materialised(inside(self.reads.select("path", "read", "ps", "pe"), exprs).select(*ends, "read"))
        self.calls_in = materialised(inside(self.calls.select("path", "call", "ps", "pe"), exprs).select(*ends, "call"))
        clean = self.clean.select("path", "rule", "s", "e")
        points = role("source").select("path", "rule", F.col("s").alias("ps"), F.col("e").alias("pe"))
        washed = inside(points.withColumnRenamed("rule", "of"), clean).where("of = rule").select("path", "rule", "ps", "pe").distinct()
        sources = points.join(washed, ["path", "rule", "ps", "pe"], "left_anti")
        self.direct = materialised(inside(sources, exprs).select(*ends, "rule", F.struct(F.lit("s").alias("kind"), F.col("ps").cast("int").alias("at"), F.lit(0).alias("k")).cast(ORIGIN).alias("origin")).distinct())
        self.clean_reads = materialised(inside(self.reads.select("path", "read", "ps", "pe"), clean).select("path", "rule", "read").distinct())
        self.clean_calls = materialised(inside(self.calls.select("path", "call", "ps", "pe"), clean).select("path", "rule", "call").distinct())
        self.assigns = assigns.select(*ends, "scope", "base", "fields", "at")


# -- solving --------------------------------------------------------------------------------------------------------------------
class Solution:
    """What flows where under each rule: reads' origins, calls that bring origins, what functions return."""

    def __init__(self, filed: DataFrame, rules: list[dict], rounds: int = ROUNDS):
        rules = [r for r in rules if r["kind"] == "taint" and any(LANGUAGES[lang].dataflow for lang in r["languages"])]
        self.r = r = Relations(filed, rules)
        written = r.reads_in.join(r.assigns, ["path", "s", "e"]).select("path", "read", "scope", "base", "fields", "at")
        self.spread = Spread(r.reads.select("path", "read", "scope", "base", "fields", "at"), written, r.around, r.clean_reads)
        put = r.params.unionByName(r.direct.join(r.assigns, ["path", "s", "e"]).select(*CELL, "origin", "at"))
        self.brought = None
        for _ in range(rounds):
            self.spread.grow(put)
            self.summary = materialised(self._returned())
            gained = materialised(self._gained())
            if gained.isEmpty():
                break
            self.brought = gained if self.brought is None else self.brought.unionByName(gained)
            put = self._in_calls(gained).join(r.assigns, ["path", "s", "e"]).select(*CELL, "origin", "at")

    def _in_calls(self, brought: DataFrame) -> DataFrame:
        r = self.r
        return r.calls_in.join(brought.join(r.clean_calls, ["path", "rule", "call"], "left_anti"), ["path", "call"]).select("path", "s", "e", "rule", "origin")

    def flows(self, exprs: DataFrame | None = None) -> DataFrame:
        """path, s, e, rule, origin: what flows into expressions (path, s, e), or all."""
        r = self.r
        pick = (lambda df: df) if exprs is None else (lambda df: df.join(exprs.select("path", "s", "e").distinct(), ["path", "s", "e"], "left_semi"))
        out = pick(r.direct).unionByName(pick(r.reads_in).join(self.spread.of_reads(), ["path", "read"]).select("path", "s", "e", "rule", "origin"))
        if self.brought is not None:
            out = out.unionByName(pick(self._in_calls(self.brought)))
        return out.distinct()

    def _returned(self) -> DataFrame:
        """path, rule, name, origin of what functions return; a parameter counts for its own function only."""
        r = self.r
        got = self.flows(r.returns).join(r.returns, ["path", "s", "e"])
        return got.where("origin.kind <> 'p' OR origin.at = owner").select("path", "rule", "name", "origin").distinct()

    def _gained(self) -> DataFrame:
        """path, rule, call, origin of calls that bring something and didn't before."""
        r = self.r
        calls = r.calls.select("path", "call", "name").join(self.summary, ["path", "name"])
        if self.brought is not None:
            calls = calls.join(self.brought.select("path", "rule", "call").distinct(), ["path", "rule", "call"], "left_anti")
        own = calls.where("origin.kind <> 'p'").select("path", "rule", "call", "origin")
        passed = calls.where("origin.kind = 'p'").select("path", "rule", "call", F.col("origin.k").alias("k")).join(r.args.select("path", "call", "k", "s", "e"), ["path", "call", "k"])
        return own.unionByName(passed.join(self.flows(passed), ["path", "s", "e", "rule"]).select("path", "rule", "call", "origin")).distinct()

    def verdicts(self) -> DataFrame:
        """path, rule_id, start, end, verdict of each sink."""
        r = self.r
        got = self.flows(r.sinks).join(r.sinks, ["path", "s", "e", "rule"])
        into = materialised(got.select("path", "rule", "s", "e", "origin"))
        parts = into.where("origin.kind = 'p'").join(r.names.withColumnRenamed("name", "func"), (into["path"] == r.names["path"]) & (into["origin.at"] == r.names["scope"])).select(into["path"], "rule", "s", "e", "func", F.col("origin.k").alias("param"))
        passed = self.flows(r.args).join(r.args.select("path", "name", "call", "k", "s", "e"), ["path", "s", "e"])
        callers = passed.join(r.names.select("path", F.col("scope").alias("_s"), F.col("name").alias("caller")), (passed["path"] == r.names["path"]) & (passed["origin.kind"] == "p") & (passed["origin.at"] == F.col("_s")), "left")
        group = lambda name: F.concat_ws("\x1f", passed["path"], "rule", name)
        calls = callers.select("call", group(passed["name"]).alias("func"), F.col("k").alias("arg"), (F.col("origin.kind") != "p").alias("source"), F.when(F.col("caller").isNotNull(), group(F.col("caller"))).alias("caller"), F.when(F.col("caller").isNotNull(), F.col("origin.k")).alias("caller_param")).withColumnRenamed("call", "call_id")
        stitched = flow.stitch(parts.select(F.struct("path", "rule", "s", "e").alias("sink_id"), F.concat_ws("\x1f", "path", "rule", "func").alias("func"), "param").distinct(), calls, LEVELS).select("sink_id.*", F.lit(True).alias("stitched"))
        reached = into.groupBy("path", "rule", "s", "e").agg(F.bool_or(F.col("origin.kind") != "p").alias("reached"), F.bool_or(F.col("origin.kind") == "p").alias("parameter"))
        spot = r.sinks.select("path", "rule", F.col("s").alias("ps"), F.col("e").alias("pe"))
        clean = r.clean.select("path", F.col("rule").alias("of"), F.col("s"), F.col("e"))
        within = intervals.enclosing(spot, clean, "path", "", "").where("of = rule").select("path", "rule", F.col("ps").alias("s"), F.col("pe").alias("e"))
        holding = intervals.enclosing(clean.select("path", "of", F.col("s").alias("ps"), F.col("e").alias("pe")), r.sinks, "path", "", "").where("of = rule").select("path", "rule", "s", "e")
        washed = within.unionByName(holding).distinct().withColumn("sanitised", F.lit(True))
        keys = ["path", "rule", "s", "e"]
        no = lambda c: F.coalesce(c, F.lit(False))
        all_ = r.sinks.join(reached, keys, "left").join(stitched, keys, "left").join(washed, keys, "left")
        return all_.select("path", F.col("rule").alias("rule_id"), F.col("s").cast("int").alias("start"), F.col("e").cast("int").alias("end"), flow.verdict(no(F.col("reached")), no(F.col("stitched")), no(F.col("parameter")), no(F.col("sanitised"))).alias("verdict"))

    def summaries(self) -> DataFrame:
        """path, rule_id, function, returns_source, params, sinks: what functions of a file bring others: whether they return a
        source, which parameters they return, and which reach a sink."""
        r = self.r
        got = self.flows(r.sinks).join(r.sinks, ["path", "s", "e", "rule"]).where("origin.kind = 'p'")
        to_sinks = got.join(r.names, (got["path"] == r.names["path"]) & (got["origin.at"] == r.names["scope"])).select(got["path"], "rule", "name", F.col("origin.k").alias("sink"))
        both = self.summary.select("path", "rule", "name", F.col("origin.kind").alias("kind"), F.when(F.col("origin.kind") == "p", F.col("origin.k")).alias("param"), F.lit(None).cast("int").alias("sink")).unionByName(to_sinks.select("path", "rule", "name", F.lit("k").alias("kind"), F.lit(None).cast("int").alias("param"), "sink"))
        return both.groupBy("path", F.col("rule").alias("rule_id"), F.col("name").alias("function")).agg(F.bool_or(F.col("kind") == "s").alias("returns_source"), F.array_sort(F.collect_set("param")).alias("params"), F.array_sort(F.collect_set("sink")).alias("sinks"))

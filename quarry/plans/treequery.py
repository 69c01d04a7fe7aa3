"""Tree patterns as join plans over node rows.

A pattern is an S-expression: (kind field: (kind) @capture . (kind)? [alternatives] (#eq? @a "text")). Each nested child is an
equality join on file and parent; order and anchors are comparisons of sibling places. Comments are skipped by anchors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from dataclasses import field as made
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = re.compile(r'\s+|;[^\n]*|"(?:\\.|[^"\\])*"|[()\[\].?*+]|@[\w.-]+|#[\w-]+\??|[\w-]+:|[\w-]+')
CAPTURE = ("id", "kind", "start_byte", "end_byte", "start_line", "start_col", "end_line", "end_col", "text")


class QueryError(ValueError):
    pass


@dataclass
class Pattern:
    kind: str = "_"
    field: str | None = None
    captures: list[str] = made(default_factory=list)
    children: list = made(default_factory=list)
    choices: list = made(default_factory=list)
    predicates: list = made(default_factory=list)
    anchored: bool = False
    last: bool = False
    repeat: str = ""


def parse(text: str) -> list[Pattern]:
    """The patterns of a query."""
    toks, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise QueryError(f"unexpected {text[at]!r} at {at}")
        if not m[0].isspace() and not m[0].startswith(";"):
            toks.append(m[0])
        at = m.end()
    toks.append("")

    def tail(p: Pattern) -> Pattern:
        while toks[0] and (toks[0] in "?*+" or toks[0].startswith("@")):
            t = toks.pop(0)
            if t.startswith("@"):
                p.captures.append(t[1:])
            else:
                p.repeat = t
        return p

    def one(name: str | None) -> Pattern:
        t = toks.pop(0)
        if t == "[":
            p = Pattern(field=name)
            while toks[0] != "]":
                if not toks[0]:
                    raise QueryError("unclosed [")
                p.choices.append(one(None))
            toks.pop(0)
            return tail(p)
        if t == "_":
            return tail(Pattern(field=name))
        if t != "(":
            raise QueryError(f"unexpected {t!r}")
        p = Pattern(field=name)
        if toks[0] == "(" or toks[0] == "[":  # a group
            p = one(name)
        else:
            p.kind = toks.pop(0)
            if not re.fullmatch(r"[\w-]+", p.kind):
                raise QueryError(f"no kind: {p.kind!r}")
        anchor = False
        while toks[0] != ")":
            if not toks[0]:
                raise QueryError("unclosed (")
            if toks[0] == ".":
                toks.pop(0)
                anchor = True
            elif toks[0] == "(" and toks[1].startswith("#"):
                toks.pop(0)
                pred = []
                while toks[0] != ")":
                    if not toks[0]:
                        raise QueryError("unclosed predicate")
                    pred.append(toks.pop(0))
                toks.pop(0)
                p.predicates.append(pred)
            else:
                label = toks.pop(0)[:-1] if toks[0].endswith(":") and len(toks[0]) > 1 else None
                c = one(label)
                c.anchored, anchor = anchor, False
                p.children.append(c)
        toks.pop(0)
        p.last = anchor
        return tail(p)

    out = []
    while toks[0]:
        out.append(one(None))
    if not out:
        raise QueryError("empty query")
    return out


def prepared(nodes: DataFrame) -> DataFrame:
    """Nodes with their place among siblings that are no comments, and how many those are."""
    real = F.col("kind") != "comment"
    w = Window.partitionBy("path", "parent_id")
    out = nodes.withColumn("place", F.when(real, F.count_if(real).over(w.orderBy("sibling_ix").rowsBetween(Window.unboundedPreceding, 0)) - 1))
    return out.withColumn("places", F.count_if(real).over(w))


def _captures(p: Pattern) -> bool:
    return bool(p.captures) or any(_captures(c) for c in [*p.children, *p.choices])


def _match(p: Pattern, nodes: DataFrame, kinds: dict) -> DataFrame:
    """path, _id, _parent, _field, _ix, _place, _places and a struct for each capture."""
    if p.choices:
        parts = [_match(c, nodes, kinds) for c in p.choices]
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        if p.captures:
            own = nodes.select("path", F.col("id").alias("_id"), F.struct(*CAPTURE).alias("_own"))
            df = df.join(own, ["path", "_id"])
            df = df.withColumns({f"c_{c}": F.col("_own") for c in p.captures}).drop("_own")
    else:
        base = nodes if p.kind == "_" else nodes.where(F.col("kind") == p.kind)
        own = F.struct(*CAPTURE)
        df = base.select("path", F.col("id").alias("_id"), F.col("parent_id").alias("_parent"), F.col("field").alias("_field"), F.col("sibling_ix").alias("_ix"), F.col("place").alias("_place"), F.col("places").alias("_places"), *[own.alias(f"c_{c}") for c in p.captures])
    before, number, gap = None, 0, None

    def between(left: str | None, right: Column, touch_left: bool, touch_right: bool) -> Column:
        """Whether what stands between two places is as the repeated child before the right one asks."""
        places, repeat = gap
        low = F.lit(-1) if left is None else F.col(f"{left}_place")
        inside = F.filter(places, lambda x: (x > low) & (x < right))
        if touch_left and touch_right:
            return (F.size(inside) == right - low - 1) & (F.lit(repeat == "*") | (F.size(inside) > 0))
        if repeat == "*":
            return F.lit(True)
        near = (F.lit(not touch_left) | F.array_contains(inside, low + 1)) & (F.lit(not touch_right) | F.array_contains(inside, right - 1))
        return near & (F.size(inside) > 0)

    for c in p.children:
        number += 1
        k = f"_k{number}"
        if c.repeat in ("*", "+") and not _captures(c):
            kept = _match(c, nodes, kinds)
            kept = (kept.where(F.col("_field") == c.field) if c.field else kept).groupBy(F.col("path").alias(f"{k}_path"), F.col("_parent").alias(f"{k}_parent")).agg(F.collect_set("_place").alias(f"{k}_all"))
            df = df.join(kept, (F.col("path") == F.col(f"{k}_path")) & (F.col("_id") == F.col(f"{k}_parent")), "left")
            gap, touch = (F.coalesce(f"{k}_all", F.array().cast("array<long>")), c.repeat), c.anchored
            continue
        child = _match(c, nodes, kinds)
        if c.field:
            child = child.where(F.col("_field") == c.field)
        child = child.select(F.col("path").alias(f"{k}_path"), F.col("_parent").alias(f"{k}_parent"), F.col("_ix").alias(f"{k}_ix"), F.col("_place").alias(f"{k}_place"), F.col("_places").alias(f"{k}_places"), *[x for x in child.columns if x.startswith("c_")])
        on = (F.col("path") == F.col(f"{k}_path")) & (F.col("_id") == F.col(f"{k}_parent"))
        here = F.col(f"{k}_place")
        if before is not None:
            on &= F.coalesce(F.col(f"{k}_ix") > F.col(f"{before}_ix"), F.lit(True))
        if gap is not None:
            on &= between(before, here, touch, c.anchored)
        elif c.anchored:
            on &= here == (F.lit(0) if before is None else F.col(f"{before}_place") + 1)
        if p.last and c is p.children[-1]:
            on &= here == F.col(f"{k}_places") - 1
        df = df.join(child, on, "left" if c.repeat in ("?", "*") else "inner")
        before, gap = k, None
    if gap is not None:
        n = nodes.where("kind <> 'comment'").groupBy(F.col("path").alias("_k_path"), F.col("parent_id").alias("_k_parent")).agg(F.count("*").alias("_k_n"))
        df = df.join(n, (F.col("path") == F.col("_k_path")) & (F.col("_id") == F.col("_k_parent")), "left")
        df = df.where(between(before, F.coalesce("_k_n", F.lit(0)), touch, p.last))
    if p.last and not p.children:
        have = nodes.where("kind <> 'comment'").select("path", F.col("parent_id").alias("_id")).distinct()
        df = df.join(have, ["path", "_id"], "left_anti")
    for pred in p.predicates:
        df = df.where(_predicate(pred, df.columns))
    return df.drop(*[x for x in df.columns if x.startswith("_k")])


def _text(arg: str, columns: list[str]) -> Column:
    if arg.startswith("@"):
        if f"c_{arg[1:]}" not in columns:
            raise QueryError(f"no capture {arg}")
        return F.col(f"c_{arg[1:]}")["text"]
    return F.lit(literal(arg))


def literal(arg: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), arg[1:-1]) if arg.startswith('"') else arg


def _predicate(pred: list[str], columns: list[str]) -> Column:
    name, args = pred[0], pred[1:]
    subject = _text(args[0], columns)
    if name in ("#eq?", "#not-eq?"):
        ok = subject == _text(args[1], columns)
    elif name in ("#any-of?", "#not-any-of?"):
        ok = subject.isin(*[literal(a) for a in args[1:]])
    elif name in ("#match?", "#not-match?"):
        ok = subject.rlike(literal(args[1]))
    else:
        raise QueryError(f"unknown predicate {name}")
    return F.coalesce(~ok if name.startswith("#not-") else ok, F.lit(True))


def run(query: str, nodes: DataFrame) -> DataFrame:
    """path and a struct c_<capture> for each capture, a row for each match; nodes as prepared() makes them."""
    parts = [_match(p, nodes, {}) for p in parse(query)]
    parts = [d.select("path", *[c for c in d.columns if c.startswith("c_")]) for d in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

"""Many line rules over many lines: an index of the literals that a match can't do without.

Of each rule's pattern a set of literals is taken, one of which is in whatever it matches. Lines meet rules by equality, on a gram
of each literal; the pattern itself is tried only on lines that hold the literal. Rules without such a set are tried on all lines
of their languages, as are those of `findings.line_findings`, whose rows these are.
"""

from __future__ import annotations

import re._constants as kinds
import re._parser as parser
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.scalars import severity_rank, snippet

from . import findings

#: Characters of a gram, and of one of a literal that is long enough, alternatives of a rule's set at most.
GRAM, LONG, MOST = 3, 6, 64
#: Bits of the bitmap of grams.
BITS = 1 << 16
#: Letters that most texts are made of: the gram with the fewest of them stands for a literal.
COMMON = " etaoinsrhldu"
REPEATS = (kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT)


def required(pattern: str) -> list[str] | None:
    """Lower-cased literals of ASCII characters, with GRAM letters or digits in a row, one of which is in every match; None where none is sure. Optional
    parts, classes and look-arounds end a literal; alternatives count together."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            best = _best(parser.parse(pattern))
    except (parser.error, OverflowError, RecursionError):
        return None  # what this parser doesn't know, Spark's may
    return sorted(best) if best else None


def _better(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    if not b or len(b) > MOST or min(map(len, b)) < GRAM:
        return a
    if not all(map(_gram, b)):
        return a
    rank = lambda s: (min(map(len, s)), -len(s))
    return b if a is None or rank(b) > rank(a) else a


def _one(items) -> str:
    items = list(items)
    return chr(items[0][1]).lower() if len(items) == 1 and items[0][0] is kinds.LITERAL and items[0][1] < 128 else ""


def _best(items) -> set[str] | None:
    run, best = "", None
    for op, value in [*items, (None, None)]:
        if op is kinds.LITERAL and value < 128:
            run += chr(value).lower()
            continue
        # a character that repeats ends one literal and begins the next
        again = _one(value[2]) if op in REPEATS and value[0] > 0 else ""
        best, run = _better(best, {run + again} if run + again else None), again
        if op is kinds.SUBPATTERN:
            inner = list(value[3])
            if all(o is kinds.LITERAL and v < 128 for o, v in inner):
                run = "".join(chr(v).lower() for _, v in inner)
            else:
                best = _better(best, _best(inner))
        elif op is kinds.ATOMIC_GROUP:
            best = _better(best, _best(value))
        elif op in REPEATS and value[0] > 0 and not again:
            best = _better(best, _best(value[2]))
        elif op is kinds.BRANCH:
            each = [_best(b) for b in value[1]]
            best = _better(best, set().union(*each) if all(each) else None)
    return best


def _gram(literal: str) -> str | None:
    """The gram of letters and digits that stands for a literal; None where it has none."""
    for size in (LONG, GRAM):
        grams = [g for g in (literal[i : i + size] for i in range(len(literal) - size + 1)) if g.isalnum()]
        if grams:
            break
    else:
        return None
    return min(grams, key=lambda g: (sum(c in COMMON for c in g), g))


def index(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """gram, literal, earlier (the rule's literals before it), and the rule: a row for each literal of each rule that has some."""
    rows = []
    for r in rules:
        found = required(r["pattern"]) or []
        rows += [(_gram(l), l, found[:k], r["id"], r["severity"], r["pattern"], r.get("unless"), list(r.get("langs") or [])) for k, l in enumerate(found)]
    return spark.createDataFrame(rows, "gram string, literal string, earlier array<string>, rule_id string, severity string, pattern string, unless string, langs array<string>")


def candidates(lines: DataFrame, rules: list[dict]) -> DataFrame:
    """lines (with lang and line_text) beside each indexed rule whose pattern has to be tried: those that hold one of its literals,
    once. Grams that no literal has leave by a bitmap before lines are multiplied; the index is broadcast: it has some rows a rule."""
    low = F.lower("line_text")
    # grams lie within words, so that cutting them costs no more than a line's length
    words = F.filter(F.array_distinct(F.split(low, "[^a-z0-9]+")), lambda w: F.length(w) >= GRAM)
    known = index(lines.sparkSession, rules)
    cut = lambda size: F.flatten(F.transform(F.filter(words, lambda w: F.length(w) >= size), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - size + 1), lambda i: F.substring(w, i, F.lit(size)))))
    sizes = sorted(r[0] for r in known.select(F.length("gram")).distinct().collect()) or [GRAM]  # one or two
    grams = F.array_distinct(F.concat(*map(cut, sizes)))
    spot = lambda g: F.pmod(F.xxhash64(g), F.lit(BITS)).cast("int")
    words_ = dict.fromkeys(range(BITS // 64), 0)
    for r in known.select(spot(F.col("gram")).alias("at")).distinct().collect():  # some rows a rule
        words_[r["at"] // 64] |= 1 << r["at"] % 64
    bits = F.lit([w - (1 << 64) if w >> 63 else w for w in words_.values()]).cast("array<bigint>")
    some = F.filter(grams, lambda g: F.getbit(F.get(bits, F.shiftright(spot(g), 6)), spot(g).bitwiseAND(F.lit(63))) == 1)
    met = lines.withColumn("gram", F.explode(some)).join(F.broadcast(known), "gram").drop("gram")
    first = F.contains(low, F.col("literal")) & ~F.exists("earlier", lambda e: F.contains(low, e))
    return met.where(first & ((F.size("langs") == 0) | F.array_contains("langs", F.col("lang")))).drop("literal", "earlier", "langs")


def line_findings(files: DataFrame, rules: list[dict]) -> DataFrame:
    """As findings.line_findings, for thousands of rules."""
    indexed = [r for r in rules if required(r["pattern"])]
    rest = [r for r in rules if not required(r["pattern"])]
    out = findings.line_findings(files, rest) if rest else None
    if indexed:
        tried = candidates(findings.lines(files), indexed).where(F.rlike("line_text", F.col("pattern")))
        tried = tried.withColumn("m", F.regexp_extract_all("line_text", F.col("pattern"), F.lit(0)))
        hit = tried.select("*", F.posexplode("m").alias("nth", "match")).where(F.col("unless").isNull() | ~F.rlike("match", F.col("unless")))
        start = _start(F.col("line_text"), F.col("pattern"), F.col("m"), F.col("nth"))
        own = hit.withColumns({"start_col": start, "severity_rank": severity_rank(F.col("severity")), "snippet": snippet(F.col("line_text"))})
        own = own.drop("line_text", "pattern", "unless", "m", "nth")
        out = own if out is None else out.unionByName(own)
    return out


def _start(line: Column, pattern: Column, matches: Column, nth: Column) -> Column:
    """Where a match starts, in bytes from 1: after the pieces and the matches before it."""
    pieces = F.split(line, pattern)
    return F.octet_length(F.concat(F.array_join(F.slice(pieces, F.lit(1), nth + 1), ""), F.array_join(F.slice(matches, F.lit(1), nth), ""))) + 1

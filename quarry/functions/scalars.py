"""Scalar functions of the scanner as column expressions; all run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("info", "low", "medium", "high", "critical")
#: Field names kept after the base of an access path.
FIELDS = 3


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.lower(severity)) - 1, F.lit(2)).cast("int")


def parse_severity(text: Column) -> Column:
    """Severity from user text: names in any case, and the aliases note, warning and error; null for others."""
    low = F.lower(F.trim(text))
    return F.when(low.isin(*SEVERITIES), low).when(low == "note", "info").when(low == "warning", "medium").when(low == "error", "high")


def sarif_level(severity: Column) -> Column:
    return F.when(severity == "info", "note").when(severity.isin("low", "medium"), "warning").otherwise("error")


def security_severity(severity: Column) -> Column:
    #: fixed values
    return F.when(severity == "info", "0.0").when(severity == "low", "3.0").when(severity == "medium", "5.5").when(severity == "high", "8.0").when(severity == "critical", "9.5")


def strip(text: Column) -> Column:
    """Without white space at both ends (Spark's own trim knows blanks only)."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def snippet(line: Column) -> Column:
    return F.substring(strip(line), 1, 400)


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def fingerprint(rule: Column, path: Column, snip: Column, occurrence: Column) -> Column:
    """32 hex digits that survive moved lines: rule, path, trimmed snippet and which occurrence of it this is."""
    return F.substring(F.sha2(F.concat_ws("\x1f", F.lit("finding.v1"), rule, path, strip(snip), occurrence.cast("string")), 256), 1, 32)


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def last_segment(module: Column) -> Column:
    return F.element_at(F.split(module, r"[/:.]"), -1)


def unquote(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "^[\"'`]+", ""), "[\"'`]+$", "")


def normalize_join(base: Column, relative: Column) -> Column:
    """A relative module path joined to a folder: "." and empty parts go, ".." takes one part back as far as there is one."""
    parts = F.split(F.when(base == "", relative).otherwise(F.concat(base, F.lit("/"), relative)), "/")
    step = lambda acc, p: F.when((p == ".") | (p == ""), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def access_path(text: Column) -> Column:
    """struct of base and up to FIELDS fields of a dotted chain; null if a part is no identifier."""
    good = text.rlike(r"^[\p{L}_$][\p{L}\p{N}_$]*(\.[\p{L}_$][\p{L}\p{N}_$]*)*$")
    parts = F.split(text, r"\.")
    return F.when(good, F.struct(F.element_at(parts, 1).alias("base"), F.slice(parts, 2, FIELDS).alias("fields")))


def render_path(path: Column) -> Column:
    """An access path as dotted text."""
    return F.array_join(F.concat(F.array(path["base"]), path["fields"]), ".")


def node_path(text: Column) -> Column:
    """The access path of a plain chain, else the first name in the text without fields; null where there is none."""
    first = F.regexp_extract(text, r"[\p{L}_$][\p{L}\p{N}_$]*", 0)
    return F.coalesce(access_path(text), F.when(first != "", F.struct(first.alias("base"), F.array().cast("array<string>").alias("fields"))))


def import_local(alias: Column, name: Column, module: Column) -> Column:
    """What an import is called here: its alias, else its name, else the last part of its module's path."""
    return F.coalesce(alias, name, F.element_at(F.split(module, "/"), -1))


def is_source(origin: Column) -> Column:
    """Whether an origin is a source itself or what a linked call brings, and no parameter."""
    return origin.isin("s", "x")


def category(text: Column) -> Column:
    """security or quality, in any case; null for others."""
    low = F.lower(F.trim(text))
    return F.when(low.isin("security", "quality"), low)


def paths_overlap(a: Column, b: Column) -> Column:
    """Same base, and one's fields are the start of the other's."""
    n = F.least(F.size(a["fields"]), F.size(b["fields"]))
    return (a["base"] == b["base"]) & (F.slice(a["fields"], F.lit(1), n) == F.slice(b["fields"], F.lit(1), n))


def contains(outer_start: Column, outer_end: Column, start: Column, end: Column) -> Column:
    return (outer_start <= start) & (end <= outer_end)


def glob_regex(glob: str) -> str:
    """A path glob as a regular expression; * and ? cross folders, [..] and {a,b} as usual."""
    out, depth, i = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            while glob[i + 1 : i + 2] == "*":
                i += 1
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and "]" in glob[i + 2 :]:
            j = glob.index("]", i + 2)
            body = glob[i + 1 : j]
            out.append("[" + ("^" + body[1:] if body[:1] == "!" else body).replace("\\", "\\\\") + "]")
            i = j
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append("\\" + c if c in r"\.^$|()[]{}+*?" else c)
        i += 1
    if depth:
        raise ValueError(f"invalid glob: {glob}")
    return "^" + "".join(out) + "$"


def any_glob(path: Column, globs: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [path.rlike(glob_regex(g)) for g in globs], F.lit(False))


def message(template: str, captures: dict[str, Column]) -> Column:
    """A template with ${name} replaced by captured text, 120 characters of it at most; "?" for a capture that is missing."""
    import re

    parts = re.split(r"\$\{(\w+)\}", template)
    cols = [F.lit(p) if k % 2 == 0 else F.coalesce(F.substring(captures[p], 1, 120), F.lit("?")) if p in captures else F.lit("?") for k, p in enumerate(parts)]
    return F.concat(*cols)

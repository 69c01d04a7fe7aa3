"""What a syntax tree says, in the same terms for all languages: calls, reads, writes, functions, imports and the like.

A fact has a kind, a name (of what is called, read, written, declared), its target (the dotted chain; calls inside end in "()"),
and spans. Trees are walked where they are parsed; everything after is relations over facts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import brace, javascript
from .objectscript import objectscript
from .pascal import pascal
from .tree import Node, Places, rows

#: Longest text of a fact that is kept; spans are never shortened.
TEXT = 400
#: Facts that a Python worker has as dicts at once, beyond those of one file; texts whose facts it keeps for copies, and how long ones.
HELD, COPIES, SHORT = 4_000, 64, 2_000
BASE = re.compile(r"[\w$%^]*")


@dataclass
class Language:
    """Where a language's trees say what. Members, calls: kind to fields of (object, property), (callee, arguments)."""

    name: str
    parse: Callable[[str], Node]
    names: set
    members: dict
    calls: dict
    news: dict = field(default_factory=dict)
    writes: dict = field(default_factory=dict)
    functions: set = field(default_factory=set)
    params: set = field(default_factory=set)
    returns: set = field(default_factory=set)
    strings: set = field(default_factory=set)
    statements: dict = field(default_factory=dict)
    dataflow: bool = True
    folded: bool = False


JS_FUNCTIONS = {"function_declaration", "function_expression", "arrow_function", "method_definition", "generator_function_declaration", "generator_function"}


def _script(name: str) -> Language:
    return Language(
        name, javascript.parse, {"identifier", "shorthand_property_identifier", "this"}, {"member_expression": ("object", "property")}, {"call_expression": ("function", "arguments")}, {"new_expression": ("constructor", "arguments")},
        {"variable_declarator": ("name", "value"), "assignment_expression": ("left", "right"), "augmented_assignment_expression": ("left", "right"), "for_in_statement": ("left", "right"), "assignment_pattern": ("left", "right"), "pair": ("key", "value")},
        JS_FUNCTIONS, {"formal_parameters", "required_parameter", "optional_parameter"}, {"return_statement"}, {"string", "template_string"}, {"debugger_statement": "debugger", "catch_clause": "catch"},
    )


LANGUAGES = {
    **{n: _script(n) for n in ("javascript", "typescript", "tsx")},
    "csharp": Language(
        "csharp", brace.csharp, {"identifier"}, {"member_access_expression": ("expression", "name")}, {"invocation_expression": ("function", "arguments")}, {"object_creation_expression": ("type", "arguments")},
        {"variable_declarator": ("name", "value"), "assignment_expression": ("left", "right"), "property_declaration": ("name", "value")}, {"method_declaration", "constructor_declaration", "local_function_statement", "lambda_expression"}, {"parameter"}, {"return_statement", "arrow_expression_clause"}, {"string_literal", "interpolated_string_expression"}, {"catch_clause": "catch"},
    ),
    "go": Language(
        "go", brace.go, {"identifier"}, {"selector_expression": ("operand", "field")}, {"call_expression": ("function", "arguments")}, {"composite_literal": ("type", "body")},
        {"short_var_declaration": ("left", "right"), "assignment_statement": ("left", "right"), "var_spec": ("name", "value"), "const_spec": ("name", "value"), "keyed_element": (0, 1)}, {"function_declaration", "method_declaration", "func_literal"}, {"parameter_declaration"}, {"return_statement"}, {"interpreted_string_literal"}, {},
    ),
    "rust": Language(
        "rust", brace.rust, {"identifier"}, {"field_expression": ("value", "field"), "scoped_identifier": ("path", "name")}, {"call_expression": ("function", "arguments"), "macro_invocation": ("macro", 1)}, {},
        {"let_declaration": ("pattern", "value"), "assignment_expression": ("left", "right"), "compound_assignment_expr": ("left", "right"), "let_condition": ("pattern", "value"), "for_expression": ("pattern", "value"), "const_item": ("name", "value"), "static_item": ("name", "value"), "field_initializer": ("field", "value")},
        {"function_item", "closure_expression"}, {"parameter"}, {"return_expression"}, {"string_literal"}, {"unsafe_block": "unsafe"},
    ),
    "pascal": Language(
        "pascal", pascal, {"identifier"}, {"exprDot": ("lhs", "rhs")}, {"exprCall": ("entity", "args")}, {}, {"assignment": ("lhs", "rhs"), "declConst": ("name", "defaultValue"), "declVar": ("name", "defaultValue")},
        {"defProc", "lambda"}, {"declArg"}, set(), {"literalString"}, {"with": "with", "goto": "goto"}, folded=True,
    ),
    "objectscript": Language(
        "objectscript", objectscript, {"lvn", "gvn", "instance_variable"}, {}, {}, {}, {"set_argument": (0, 1), "for_argument": (0, 1)}, {"method_definition"}, {"argument"}, {"command_return", "command_quit"}, {"string_literal"},
        {"command_zwrite": "zwrite", "command_goto": "goto", "command_ztrap": "ztrap", "command_break": "break", "catch_block": "catch", "indirection": "indirection", "command_xecute": "xecute", "command_open": "open", "command_use": "use", "command_write": "write", "command_read": "read"},
    ),
}

#: What a profile may say, and how: lists of kinds, or kinds with two fields (names, or places among the children).
LISTS, PAIRS = ("names", "functions", "params", "returns", "strings"), ("members", "calls", "news", "writes")


def from_profile(name: str, parse: Callable[[str], Node], profile: dict | None) -> tuple[Language, list[str]]:
    """A language from its parser and a profile (a YAML document), with warnings. Without a profile there are trees but no data
    flow; a section that isn't as it should be is left out by itself."""
    warnings, good = [], {}
    for section, value in (profile or {}).items():
        if section in LISTS and isinstance(value, list) and all(isinstance(v, str) for v in value):
            good[section] = set(value)
        elif section in PAIRS and isinstance(value, dict) and all(isinstance(v, list) and len(v) == 2 and all(isinstance(x, (str, int)) for x in v) for v in value.values()):
            good[section] = {k: tuple(v) for k, v in value.items()}
        elif section == "statements" and isinstance(value, dict) and all(isinstance(v, str) for v in value.values()):
            good[section] = value
        elif section == "folded" and isinstance(value, bool):
            good[section] = value
        else:
            warnings.append(f"profile {name}: section {section} is left out")
    for section in ("names", "members", "calls"):
        good.setdefault(section, set() if section == "names" else {})
    return Language(name, parse, **good, dataflow=bool(profile)), warnings


SPAN = "struct<text:string,start:int,end:int,kind:string,line:int,col:int>"
FACT = f"fact string, name string, target string, base string, module string, receiver string, symbol string, resolution string, args array<{SPAN}>, value {SPAN}, start int, end int, line int, col int, end_line int, end_col int, text string, snippet string, scope int, param int"
FACTS = "struct<" + re.sub(r"(^|, )(\w+) ", r"\1\2:", FACT) + ">"
FACT_NAMES = [c.split()[0] for c in FACT.replace(SPAN, "x").split(", ")]
EMPTY = dict.fromkeys(FACT_NAMES)
_SPAN = pa.struct([("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("line", pa.int32()), ("col", pa.int32())])
_TYPES = {"args": pa.list_(_SPAN), "value": _SPAN} | dict.fromkeys(("start", "end", "line", "col", "end_line", "end_col", "scope", "param"), pa.int32())
ARROW = pa.struct([(n, _TYPES.get(n, pa.string())) for n in FACT_NAMES])


class Walk:
    """The facts of one file."""

    def __init__(self, language: Language, text: str):
        self.l, self.text, self.places = language, text, Places(text)
        self.root = language.parse(text)
        self.lines = text.split("\n")
        self.facts: list[dict] = []
        self.imports: dict[str, tuple] = {}
        self.locals: set = set()

    def at(self, n: Node) -> tuple[int, int]:
        return self.places.spot(n.start)[0], self.places.spot(n.end)[0]

    def words(self, n: Node) -> str:
        return self.text[n.start : min(n.end, n.start + TEXT)]

    def chain(self, n: Node | None) -> str:
        """The dotted chain of an expression: names and members as they are, calls with "()", other things "?"."""
        parts: list[str] = []
        while n is not None:
            if n.kind in self.l.members:
                owner, name = self.l.members[n.kind]
                parts.append(self.words(n.get(name)) if n.get(name) else "?")
                n = n.get(owner)
            elif n.kind in self.l.calls:
                parts.append("()")
                n = n.get(self.l.calls[n.kind][0])
            elif n.kind in ("index_expression", "subscript_expression", "element_access_expression", "exprSubscript"):
                parts.append("[]")
                n = n.children[0][1]
            elif n.kind in ("parenthesized_expression", "exprParens", "reference_expression", "unary_expression", "try_expression", "await_expression", "argument", "non_null_expression", "exprDeref", "postfix_unary_expression") and len(n.children) == 1:
                n = n.children[0][1]
            else:
                leaf = not n.children or n.kind == "type"
                parts.append(self.words(n).lstrip("@&") if leaf and re.fullmatch(r"[@&%^*\[\]]*[\w$.%:]+", self.words(n)) else "?")
                break
        out = ""
        for p in reversed(parts):
            out += p if p in ("()", "[]") else ("." if out else "") + p
        return out

    def span(self, n: Node) -> dict:
        (start, line, col), (end, _, _) = self.places.spot(n.start), self.places.spot(n.end)
        return {"text": self.words(n), "start": start, "end": end, "kind": self.sort(n), "line": line, "col": col}

    def sort(self, n: Node) -> str:
        """literal, name or other; what a wrapper holds counts."""
        while n.kind in ("argument", "expression", "method_arg", "literal_element", "expression_list", "expression_statement", "reference_expression", "device", "set_target", "xecute_argument", "write_argument") and len(n.children) == 1:
            n = n.children[0][1]
        if n.kind in self.l.strings:
            return "literal" if all(c.kind.startswith("string") or c.kind in ("escape_sequence",) for _, c in n.children) else "built"
        if n.kind in ("number", "number_literal", "literalNumber", "numeric_literal", "true", "false", "kTrue", "kFalse", "kNil", "nil", "null", "boolean_literal"):
            return "constant"
        if n.kind in self.l.names:
            return "name"
        if n.kind == "macro_invocation":
            return "macro:" + self.chain(n.get("macro"))
        return "other"

    def add(self, fact: str, n: Node, name: str = "", target: str = "", **more) -> dict:
        (start, line, col), (end, end_line, end_col) = self.places.spot(n.start), self.places.spot(n.end)
        base = BASE.match(target)[0] if target else ""
        self.facts.append({**EMPTY, "fact": fact, "name": name, "target": target, "base": base, "args": [], "start": start, "end": end, "line": line, "col": col, "end_line": end_line, "end_col": end_col, "text": self.words(n), **more})
        return self.facts[-1]

    def listed(self, n: Node | None) -> list[Node]:
        return [c for _, c in n.children if c.kind != "comment"] if n is not None else []

    def field(self, n: Node, at) -> Node | None:
        if isinstance(at, str):
            return n.get(at)
        kids = self.listed(n)
        return kids[at] if at < len(kids) else None

    def run(self) -> list[dict]:
        todo: list = [(self.root, None, None)]
        while todo:
            n, parent, f = todo.pop()
            self.visit(n, parent, f)
            if n.children:
                todo.extend([(c, n, ff) for ff, c in reversed(n.children)])
        self.finish()
        return self.facts

    # -- one node ----------------------------------------------------------------------------------------------------
    def visit(self, n: Node, parent: Node | None, f) -> None:
        k, l = n.kind, self.l
        if l.name == "objectscript":
            self.objectscript(n, parent)
        if k in l.calls:
            callee = n.get(l.calls[k][0])
            target = self.chain(callee)
            args = self.listed(self.field(n, l.calls[k][1]))
            name = re.split(r"[.!]", target.rstrip("!"))[-1]
            self.add("macro" if k == "macro_invocation" else "call", n, name, target, receiver=target.rpartition(".")[0], args=[self.span(a) for a in args])
            if name == "require" and l.name in ("javascript", "typescript", "tsx") and len(args) == 1 and self.sort(args[0]) == "literal":
                self.required(parent, f, self.words(args[0]).strip("\"'`"))
        elif k in l.news:
            made, args = n.get(l.news[k][0]), n.get(l.news[k][1])
            target = self.chain(made) if made is not None else ""
            self.add("new", n, target.split(".")[-1].split("<")[0], target, args=[self.span(a) for a in self.listed(args)])
        elif k in l.members and not (parent is not None and parent.kind in l.members and f == l.members[parent.kind][0]):
            self.read(n)
        elif k in l.names and not (parent is not None and (parent.kind in l.members or self.declares(parent, f))):
            self.read(n)
        if k in l.writes:
            self.write(n)
        if k in l.functions:
            self.function(n, parent)
        if k in l.returns:
            for v in self.listed(n)[:1]:
                self.add("return", v, value=self.span(v))
        if k in l.statements:
            body = n.get("body") or next((c for _, c in n.children if c.kind in ("block", "statement_block")), None)
            self.add("statement", n, l.statements[k], value=self.span(body) if body else self.span(n.children[0][1]) if n.children else None)
        if k in ("class_declaration", "struct_declaration", "interface_declaration", "record_declaration") and n.get("name") is not None:
            self.add("type", n, self.words(n.get("name")))
        if k in IMPORTS:
            IMPORTS[k](self, n)
        if k == "try" and l.name == "pascal":
            self.handlers(n)

    def declares(self, parent: Node, f) -> bool:
        return f == "name" and (parent.kind in self.l.functions or parent.kind in ("variable_declarator", "parameter", "parameter_declaration", "declProc", "class_declaration", "declArg", "declVar")) or parent.kind in ("parameter", "import_specifier", "typeref", "set_target_list")

    def read(self, n: Node) -> None:
        target = self.chain(n)
        if target and "?" not in target:
            self.add("read", n, target.split(".")[-1], target)

    def targets(self, n: Node) -> Iterator[Node]:
        """What a pattern on the left of an assignment binds."""
        kind = n.kind
        if kind in ("expression_list", "tuple_pattern", "set_target", "set_target_list", "array_pattern", "object_pattern", "assignment_pattern", "pair_pattern", "rest_pattern", "lexical_declaration", "variable_declaration", "literal_element", "shorthand"):
            kids = self.listed(n)
            for c in kids[-1:] if kind == "pair_pattern" else kids[:1] if kind == "assignment_pattern" else kids:
                yield from self.targets(c)
        elif kind in ("variable_declarator",):
            yield from self.targets(n.get("name"))
        else:
            yield n

    def write(self, n: Node) -> None:
        left, right = (self.field(n, at) for at in self.l.writes[n.kind])
        lefts = [c for f, c in n.children if f == "name"] if n.kind in ("var_spec", "const_spec", "declVar", "declConst") else [left] if left is not None else []
        if right is None or not lefts:
            return
        bound = [t for x in lefts for t in self.targets(x)]
        values = self.listed(right) if right.kind == "expression_list" else [right]
        for k, t in enumerate(bound):
            value = values[k] if len(values) == len(bound) else right if len(values) != 1 else values[0]
            target = self.chain(t) if self.l.name != "objectscript" else self.os_chain(t)
            self.add("assign", n, re.split(r"\.", target)[-1], target, value=self.span(value), param=self.at(t)[0])

    def function(self, n: Node, parent: Node | None) -> None:
        head = n.get("header") or n
        name = head.get("name") or next((c for _, c in n.children if c.kind == "method_name"), None)
        if name is None and parent is not None and parent.kind in ("variable_declarator", "pair", "assignment_expression", "short_var_declaration"):
            name = parent.get("name") or parent.get("key")
        made = self.add("function", n, self.words(name) if name is not None else None)
        self.locals.add(made["name"])
        params = head.get("parameters") or head.get("args") or head.get("parameter") or next((c for _, c in n.children if c.kind == "arguments"), None)
        found: list[Node] = []
        for p in [params] if params is not None and params.kind in self.l.names else self.listed(params):
            names = [c for f, c in p.children if f in ("name", "pattern") and c.kind in self.l.names]
            inner = names or [x for x in self.targets(p) if x.kind in self.l.names or x.kind.startswith("shorthand")]
            if not inner and self.l.name == "objectscript":
                inner = [next(x for x in p.nodes() if x.kind == "lvn")]
            if not inner:
                inner = [next((x for x in p.nodes() if x.kind in self.l.names), p)]
            found.append(inner)
        k = 0
        for inner in found:
            several = self.l.name in ("go", "pascal")  # names that share a type are parameters of their own
            for x in inner:
                self.add("param", x, self.words(x), self.words(x), scope=made["start"], param=k)
                k += several
            k += not several
        body = n.get("body")
        if body is not None and self.l.name in ("csharp", "rust") or n.kind == "arrow_function":
            last = self.listed(body)[-1] if body is not None and body.kind == "block" and self.l.name == "rust" and self.listed(body) else body
            if last is not None and last.kind == "expression_statement" and not self.text[last.start : last.end].endswith(";"):
                last = last.children[0][1]
            elif last is not None and last.kind in ("expression_statement", "block", "statement_block", "let_declaration", "arrow_expression_clause"):
                last = None
            if last is not None:
                self.add("return", last, value=self.span(last))

    # -- imports -----------------------------------------------------------------------------------------------------
    def imported(self, n: Node, local: str, module: str, name: str) -> None:
        self.imports.setdefault(local, (module, name))
        self.add("import", n, local, module, module=module, receiver=name)

    def required(self, parent: Node | None, f, module: str) -> None:
        if parent is None or parent.kind != "variable_declarator":
            return
        left = parent.get("name")
        if left.kind == "identifier":
            self.imported(parent, self.words(left), module, "*")
        elif left.kind == "object_pattern":
            for c in self.listed(left):
                kids = self.listed(c)
                self.imported(c, self.words(kids[-1] if kids else c), module, self.words(kids[0] if kids else c))

    def import_import_statement(self, n: Node) -> None:
        source = n.get("source") or next((c for c in n.nodes() if c.kind == "string"), None)
        if source is None:
            return
        module = self.words(source).strip("\"'`")
        for c in n.nodes():
            if c.kind == "import_specifier":
                name, alias = c.get("name"), c.get("alias")
                self.imported(c, self.words(alias or name), module, self.words(name))
            elif c.kind == "namespace_import":
                self.imported(c, self.words(self.listed(c)[-1]), module, "*")
            elif c.kind == "import_clause":
                for x in self.listed(c):
                    if x.kind == "identifier":
                        self.imported(x, self.words(x), module, "default")

    def import_import_spec(self, n: Node) -> None:
        module = self.words(n.get("path")).strip('"`')
        alias = n.get("name")
        self.imported(n, self.words(alias) if alias is not None else module.rsplit("/", 1)[-1], module, "*")

    def import_using_directive(self, n: Node) -> None:
        path, alias = self.chain(n.get("name")), n.get("alias")
        self.imported(n, self.words(alias) if alias is not None else path.rsplit(".", 1)[-1], path, "*")

    def import_use_declaration(self, n: Node) -> None:
        def walk(x: Node, prefix: str) -> None:
            join = lambda a, b: f"{a}::{b}" if a else b
            if x.kind == "use_list":
                for c in self.listed(x):
                    walk(c, prefix)
            elif x.kind in ("scoped_use_list", "use_wildcard"):
                path = x.get("path")
                if path is not None:
                    walk(x.get("list"), join(prefix, self.words(path).replace(" ", "")))
            else:
                path = join(prefix, self.words(x.get("path") if x.kind == "use_as_clause" else x))
                local = self.words(x.get("alias")) if x.kind == "use_as_clause" else path.rsplit("::", 1)[-1]
                self.imported(x, local, path.rpartition("::")[0], path.rsplit("::", 1)[-1])

        if n.get("argument") is not None:
            walk(n.get("argument"), "")

    def import_declUses(self, n: Node) -> None:  # noqa: N802
        for c in self.listed(n):
            self.imported(c, self.words(c), self.words(c), "*")

    # -- what only one language has ------------------------------------------------------------------------------------
    def handlers(self, n: Node) -> None:
        kinds = [c.kind for c in self.listed(n)]
        if "kExcept" not in kinds:
            return
        at = kinds.index("kExcept")
        plain = n.get("except")
        bare = plain is not None and plain.kind == "statements"
        self.add("statement", n, "empty except" if kinds[at + 1 :] in (["kEnd"], []) else "catch all" if bare else "except")

    def os_chain(self, n: Node) -> str:
        while n.kind in ("set_target", "expression", "method_arg") and len(self.listed(n)) == 1:
            n = self.listed(n)[0]
        if n.kind == "oref_chain_expr":
            kids = self.listed(n)
            out = self.os_chain(kids[0])
            for c in kids[1:]:
                inner = c.children[0][1]
                out += "." + self.words(inner.children[0][1]) + ("()" if inner.kind == "oref_method" else "")
            return out
        if n.kind == "lvn":
            return re.match(r"%?\w*", self.words(n))[0]
        if n.kind == "gvn":
            return "^" + re.match(r"\^?([%\w.]*)", self.words(n))[1]
        if n.kind == "instance_variable":
            return self.words(n)
        return "?"

    def objectscript(self, n: Node, parent: Node | None) -> None:
        kids = self.listed(n)
        if n.kind in ("oref_method", "class_method_call", "system_defined_function", "routine_tag_call"):
            name = next((self.words(c) for c in kids if c.kind == "method_name"), "")
            args = next((self.listed(c) for c in kids if c.kind == "method_args"), [c for c in kids if c.kind == "method_arg"])
            head = re.match(r"[^(]*", self.words(n))[0]
            if n.kind == "class_method_call":
                owner = self.words(next(c for c in n.nodes() if c.kind == "class_name")).strip('"')
                self.add("call", n, name, f"{owner}.{name}", receiver=owner, args=[self.span(a) for a in args], module="class")
            elif n.kind == "oref_method":
                own = parent is not None and parent.kind == "relative_dot_method"
                self.add("call", n, name, name if own else "?." + name, receiver="" if own else "?", args=[self.span(a) for a in args], module="self" if own else "object")
            elif n.kind == "routine_tag_call":
                self.add("call", n, head.strip("$").split("^")[0], head.strip("$"), args=[self.span(a) for a in args], module="routine")
            else:
                self.add("call", n, name or head.lower(), head.lower(), args=[self.span(a) for a in args], module="system")
        elif n.kind == "oref_chain_expr" and parent is not None and parent.kind != "set_target":
            self.add("read", n, "", self.os_chain(n))
        elif n.kind == "read_variable":
            target = self.os_chain(kids[0]) if kids else ""
            self.add("statement", n, "read into", target)
            self.add("assign", n, target, target, value=self.span(n), param=self.at(n)[0])

    def resolve(self, f: dict) -> None:
        """What a call or read is by this file's imports and functions: imports come before functions; what a whole module brings
        in resolves its members, not bare names."""
        first, _, rest = f["target"].partition(".")
        module, name = self.imports.get(first, (None, None))
        if rest:
            f["module"], f["symbol"], f["resolution"] = module, f["name"], "external" if module else "member"
        elif module and name != "*":
            f["module"], f["symbol"], f["resolution"] = module, name, "external"
        else:
            f["module"], f["symbol"], f["resolution"] = module if f["fact"] == "read" else None, f["name"], "local" if f["name"] in self.locals else "unresolved"

    def finish(self) -> None:
        """Modules of what imports bring in, innermost functions, and each fact's line."""
        fold = str.lower if self.l.folded else (lambda x: x)
        scopes = sorted((f["start"], -f["end"]) for f in self.facts if f["fact"] == "function")
        open_: list = []
        k = 0
        for f in sorted(self.facts, key=lambda f: (f["start"], -f["end"], f["fact"] != "function")):
            while k < len(scopes) and scopes[k][0] <= f["start"]:
                open_.append(scopes[k])
                k += 1
            while open_ and -open_[-1][1] <= f["start"] and f["end"] > -open_[-1][1]:
                open_.pop()
            if f["fact"] != "param":
                inside = [s for s in open_ if s[0] <= f["start"] and f["end"] <= -s[1] and not (f["fact"] == "function" and s == (f["start"], -f["end"]))]
                f["scope"] = inside[-1][0] if inside else -1
            f["snippet"] = self.lines[f["line"] - 1].strip()[:400] if f["line"] <= len(self.lines) else ""
            if f["module"] is None and f["fact"] in ("call", "new", "read", "macro"):
                self.resolve(f)
            if self.l.folded and f["target"]:
                f["base"] = fold(f["base"])


#: Kinds of nodes that import something, and what reads them.
IMPORTS = {name.removeprefix("import_"): f for name, f in vars(Walk).items() if name.startswith("import_")}


def facts_of(lang: str, text: str) -> list[dict]:
    """All facts of a file, in the order of the tree; no text raises."""
    return Walk(LANGUAGES[lang], text).run()


def parsed(langs: list[str], texts: list[str]) -> Iterator[tuple[int, list[list[dict]]]]:
    """The first place and the facts of some files after another, HELD facts or one file at a time. Copies of a short text are
    parsed once: their facts are the same objects, which nobody may change."""
    known = lru_cache(COPIES)(facts_of)
    first, held, n = 0, [], 0
    for i, (lang, text) in enumerate(zip(langs, texts)):
        held.append((known if len(text) <= SHORT else facts_of)(lang, text))
        n += len(held[-1])
        if n >= HELD:
            yield first, held
            first, held, n = i + 1, [], 0
    if held:
        yield first, held


def unpacked(lists: pa.Array) -> Iterator[tuple[int, list]]:
    """The first place and the plain values of some rows of lists after another, HELD items or one row at a time."""
    ends = lists.offsets.to_pylist()
    first = 0
    for i in range(1, len(ends)):
        if i == len(ends) - 1 or ends[i + 1] - ends[first] > HELD:
            yield first, plain(lists.slice(first, i - first))
            first = i


def plain(a: pa.Array) -> list:
    """As to_pylist(), column by column: not a scalar a value."""
    if pa.types.is_list(a.type):
        ends = a.offsets.to_pylist()
        items = plain(a.values.slice(ends[0], ends[-1] - ends[0]))
        out = [items[x - ends[0] : y - ends[0]] for x, y in pairwise(ends)]
    elif pa.types.is_struct(a.type):
        names = [f.name for f in a.type]
        out = [dict(zip(names, row)) for row in zip(*(plain(a.field(k)) for k in range(len(names))))]
    elif a.null_count == len(a):
        return [None] * len(a)
    elif pa.types.is_string(a.type):
        return a.to_numpy(zero_copy_only=False).tolist()
    elif pa.types.is_integer(a.type):
        out = a.fill_null(0).to_numpy(zero_copy_only=False).tolist()
    else:
        return a.to_pylist()
    return out if a.null_count == 0 else [x if there else None for x, there in zip(out, a.is_valid().to_pylist())]


def with_facts(files: DataFrame, keep: tuple = ()) -> DataFrame:
    """path, lang, facts (and the columns to keep) of files (path, lang, text) whose language has a front-end: the one Python step
    between texts and findings. An array a file, so that what is asked of a file needs no shuffle, nor does what goes along."""
    kept = files.select(*keep).schema.fields
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("facts", T._parse_datatype_string(f"array<{FACTS}>")), *kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, made in parsed(*(batch.column(k).to_pylist() for k in (1, 2))):
                same = [batch.column(k).slice(i, len(made)) for k in range(batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*same[:2], pa.array(made, pa.list_(ARROW)), *same[3:]], ["path", "lang", "facts", *keep])

    return texts(files, keep).mapInArrow(run, schema)


def texts(files: DataFrame, keep: tuple = ()) -> DataFrame:
    """path, lang, text (and the columns to keep) of files whose language has a front-end; null text is empty."""
    return files.where(F.col("lang").isin([*LANGUAGES])).select("path", "lang", F.coalesce("text", F.lit("")).alias("text"), *keep)


def facts(filed: DataFrame) -> DataFrame:
    """A row a fact."""
    return filed.select("path", "lang", F.explode("facts").alias("f")).select("path", "lang", "f.*")


def nodes(files: DataFrame) -> DataFrame:
    """The rows of all trees of files (path, lang, text), each by its language's parser."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, lang, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                yield pa.RecordBatch.from_pylist(list(rows(path, text, LANGUAGES[lang].parse)), schema=javascript.SCHEMA)

    return files.where(F.col("lang").isin([*LANGUAGES])).select("path", "lang", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, javascript.COLUMNS)

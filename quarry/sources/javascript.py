"""A tolerant JavaScript parser whose output is rows of an interval-encoded tree.

A statement that can't be parsed becomes an ERROR node up to the next statement; no input raises. Types of TypeScript are
skipped where they follow a colon in parameters and declarations.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tree
from .tree import Bad, Node

SPACE = re.compile(r"[\s﻿]+")
COMMENT = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)", re.S)
NAME = re.compile(r"#?[^\W\d][\w$]*|[$][\w$]*", re.U)
NUMBER = re.compile(r"0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?")
REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-zA-Z]*")
MARK = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@#]")
ASSIGN = {"+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}
BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "await", "yield", "instanceof"}


def tokens(text: str, at: int, stop: int) -> tuple[list[tuple], list[Node]]:
    out, comments, line = [], [], False
    while at < stop:
        c = text[at]
        if (c.isspace() or c == "\ufeff") and (m := SPACE.match(text, at, stop)):
            line |= "\n" in m[0]
            at = m.end()
            continue
        if c == "/" and (m := COMMENT.match(text, at, stop)):
            line |= "\n" in m[0]
            comments.append(Node("comment", at, m.end()))
            at = m.end()
            continue
        last = out[-1] if out else ("mark", "(", 0, 0, False)
        if c in "\"'":
            end = at + 1
            while end < stop and text[end] not in (c, "\n"):
                end += 2 if text[end] == "\\" else 1
            kind, end = "string", min(stop, end + 1)
        elif c == "`":
            kind, end = "template", _template_end(text, at + 1, stop)
        elif (c.isalnum() or c in "#$_") and (m := NAME.match(text, at, stop)):
            kind, end = "name", m.end()
        elif (c.isdecimal() or c == ".") and (m := NUMBER.match(text, at, stop)):
            kind, end = "number", m.end()
        elif c == "/" and (last[0] == "mark" and last[1] not in (")", "]", "}") or last[1] in BEFORE_REGEX) and (m := REGEX.match(text, at, stop)):
            kind, end = "regex", m.end()
        elif m := MARK.match(text, at, stop):
            kind, end = "mark", m.end()
        else:
            kind, end = "other", at + 1
        out.append((kind, text[at:end], at, end, line))
        at, line = end, False
    return out, comments


def _template_end(text: str, at: int, stop: int) -> int:
    depth = 0
    while at < stop:
        c = text[at]
        if c == "\\":
            at += 1
        elif depth == 0 and c == "`":
            return at + 1
        elif text.startswith("${", at):
            depth += 1
            at += 1
        elif depth and c == "{":
            depth += 1
        elif depth and c == "}":
            depth -= 1
        elif depth and c == "`":
            at = _template_end(text, at + 1, stop) - 1
        at += 1
    return stop


class Parser:
    def __init__(self, text: str, at: int = 0, stop: int | None = None):
        self.text, self.stop = text, len(text) if stop is None else stop
        self.toks, self.comments = tokens(text, at, self.stop)
        self.i, self.closers = 0, None

    # -- tokens ------------------------------------------------------------------------------------------------------
    def val(self, k: int = 0) -> str:
        return self.toks[self.i + k][1] if self.i + k < len(self.toks) and self.toks[self.i + k][0] in ("mark", "name") else ""

    def kind(self, k: int = 0) -> str:
        return self.toks[self.i + k][0] if self.i + k < len(self.toks) else "end"

    @property
    def start(self) -> int:
        return self.toks[self.i][2] if self.i < len(self.toks) else self.stop

    @property
    def last(self) -> int:
        return self.toks[self.i - 1][3] if self.i else 0

    def next(self) -> tuple:
        if self.i >= len(self.toks):
            raise Bad
        self.i += 1
        return self.toks[self.i - 1]

    def take(self, v: str) -> bool:
        if self.val() == v:
            self.i += 1
            return True
        return False

    def need(self, v: str) -> None:
        if not self.take(v):
            raise Bad

    def done(self, kind: str, start: int, children: list) -> Node:
        return Node(kind, start, self.last, [(f, c) for f, c in children if c is not None])

    def semi(self) -> None:
        self.take(";")

    # -- statements --------------------------------------------------------------------------------------------------
    def program(self) -> Node:
        root = Node("program", 0, len(self.text), [(None, s) for s in self.statements("")])
        for c in self.comments:
            _place(root, c)
        return root

    def statements(self, closer: str) -> list[Node]:
        out = []
        while self.i < len(self.toks) and (not closer or self.val() != closer):
            at, here = self.i, self.start
            try:
                s = self.statement()
            except (Bad, RecursionError):
                self.i = max(self.i, at + 1)
                level = 0
                while self.i < len(self.toks) and not (level <= 0 and (self.val() in (";", "}") or self.toks[self.i][4])):
                    level += (self.val() in ("{", "(", "[")) - (self.val() in ("}", ")", "]"))
                    self.i += 1
                if self.val() == "}" and not closer or self.val() == ";":
                    self.i += 1
                s = Node("ERROR", here, self.last)
            if s is not None:
                out.append(s)
            if self.i == at:
                self.i += 1
        return out

    def block(self) -> Node:
        here = self.start
        self.need("{")
        body = self.statements("}")
        self.take("}")
        return self.done("statement_block", here, [(None, s) for s in body])

    def statement(self) -> Node | None:
        v, here = self.val(), self.start
        if v == ";":
            self.i += 1
            return None
        if v == "{":
            return self.block()
        if v in ("var", "let", "const") and self.kind(1) in ("name", "mark") and (self.kind(1) == "name" or self.val(1) in ("{", "[")):
            out = self.declaration()
            self.semi()
            out.end = self.last
            return out
        if v == "function" or (v == "async" and self.val(1) == "function"):
            return self.function("function_declaration")
        if v == "class":
            return self.klass("class_declaration")
        if v == "import" and self.val(1) not in ("(", "."):
            return self.imports()
        if v == "export":
            return self.exports()
        if v == "debugger":
            self.i += 1
            self.semi()
            return self.done("debugger_statement", here, [])
        if v in ("return", "throw"):
            self.i += 1
            value = None
            if self.i < len(self.toks) and self.val() not in (";", "}") and not (self.toks[self.i][4]):
                value = self.sequence()
            self.semi()
            return self.done(v + "_statement", here, [(None, value)])
        if v == "if":
            self.i += 1
            c = self.paren()
            yes = self.statement()
            no = None
            if self.val() == "else":
                at = self.start
                self.i += 1
                s = self.statement()
                no = self.done("else_clause", at, [(None, s)])
            return self.done("if_statement", here, [("condition", c), ("consequence", yes), ("alternative", no)])
        if v in ("while", "with"):
            self.i += 1
            return self.done(v + "_statement", here, [("condition", self.paren()), ("body", self.statement())])
        if v == "do":
            self.i += 1
            body = self.statement()
            self.need("while")
            c = self.paren()
            self.semi()
            return self.done("do_statement", here, [("body", body), ("condition", c)])
        if v == "for":
            return self.loop()
        if v == "try":
            self.i += 1
            parts = [("body", self.block())]
            if self.val() == "catch":
                at = self.start
                self.i += 1
                p = None
                if self.take("("):
                    p = self.pattern()
                    self.need(")")
                parts.append(("handler", self.done("catch_clause", at, [("parameter", p), ("body", self.block())])))
            if self.val() == "finally":
                at = self.start
                self.i += 1
                parts.append(("finalizer", self.done("finally_clause", at, [("body", self.block())])))
            return self.done("try_statement", here, parts)
        if v == "switch":
            self.i += 1
            parts, at = [("value", self.paren())], self.start
            self.need("{")
            cases = []
            while self.val() not in ("}", ""):
                c = self.start
                inner = []
                if self.take("case"):
                    inner.append(("value", self.sequence()))
                else:
                    self.need("default")
                self.need(":")
                while self.val() not in ("case", "default", "}") and self.i < len(self.toks):
                    inner.append(("body", self.statement()))
                cases.append((None, self.done("switch_case", c, inner)))
            self.take("}")
            return self.done("switch_statement", here, [*parts, ("body", self.done("switch_body", at, cases))])
        if v in ("break", "continue"):
            self.i += 1
            if self.kind() == "name" and not self.toks[self.i][4]:
                self.i += 1
            self.semi()
            return self.done(v + "_statement", here, [])
        if self.kind() == "name" and self.val(1) == ":":
            self.i += 2
            return self.done("labeled_statement", here, [("body", self.statement())])
        e = self.sequence()
        self.semi()
        return self.done("expression_statement", here, [(None, e)])

    def loop(self) -> Node:
        here = self.start
        self.i += 1
        self.take("await")
        self.need("(")
        first = None
        if self.val() in ("var", "let", "const"):
            first = self.declaration(loop=True)
        elif self.val() != ";":
            first = self.sequence(no_in=True)
        if self.val() in ("of", "in"):
            self.i += 1
            right = self.sequence()
            self.need(")")
            return self.done("for_in_statement", here, [("left", first), ("right", right), ("body", self.statement())])
        self.take(";")
        c = None if self.val() == ";" else self.sequence()
        self.take(";")
        step = None if self.val() == ")" else self.sequence()
        self.need(")")
        return self.done("for_statement", here, [("initializer", first), ("condition", c), ("increment", step), ("body", self.statement())])

    def declaration(self, loop: bool = False) -> Node:
        here, word = self.start, self.next()[1]
        parts = []
        while True:
            at, name, value = self.start, self.pattern(), None
            self.annotation({"=", ",", ";", ")", "of", "in"})
            if self.take("="):
                value = self.expression(no_in=loop)
            parts.append((None, self.done("variable_declarator", at, [("name", name), ("value", value)])))
            if not self.take(","):
                break
        return self.done("variable_declaration" if word == "var" else "lexical_declaration", here, parts)

    def annotation(self, stops: set) -> None:
        """Skips a type after a colon."""
        if self.val() != ":":
            return
        level = 0
        while self.i < len(self.toks):
            v = self.val()
            if level <= 0 and v in stops or level < 0:
                return
            level += (v in ("{", "(", "[", "<")) - (v in ("}", ")", "]", ">"))
            if level < 0:
                return
            self.i += 1

    def pattern(self) -> Node:
        here = self.start
        if self.take("{"):
            parts = []
            while not self.take("}"):
                at = self.start
                if self.take("..."):
                    parts.append((None, self.done("rest_pattern", at, [(None, self.pattern())])))
                elif self.kind() == "name" and self.val(1) != ":":
                    self.i += 1
                    p = self.done("shorthand_property_identifier_pattern", at, [])
                    if self.take("="):
                        p = self.done("object_assignment_pattern", at, [("left", p), ("right", self.expression())])
                    parts.append((None, p))
                else:
                    k = self.key()
                    self.need(":")
                    parts.append((None, self.done("pair_pattern", at, [("key", k), ("value", self.defaulted())])))
                if not self.take(","):
                    self.need("}")
                    break
            return self.done("object_pattern", here, parts)
        if self.take("["):
            parts = []
            while not self.take("]"):
                if self.take(","):
                    continue
                parts.append((None, self.defaulted()))
                if not self.take(","):
                    self.need("]")
                    break
            return self.done("array_pattern", here, parts)
        if self.take("..."):
            return self.done("rest_pattern", here, [(None, self.pattern())])
        if self.kind() != "name":
            raise Bad
        self.i += 1
        return self.done("identifier", here, [])

    def defaulted(self) -> Node:
        here, p = self.start, self.pattern()
        self.take("?")
        self.annotation({"=", ",", ")", "]", "}"})
        return self.done("assignment_pattern", here, [("left", p), ("right", self.expression())]) if self.take("=") else p

    def parameters(self) -> Node:
        here, parts = self.start, []
        self.need("(")
        while not self.take(")"):
            parts.append((None, self.defaulted()))
            if not self.take(","):
                self.need(")")
                break
        return self.done("formal_parameters", here, parts)

    def function(self, kind: str) -> Node:
        here = self.start
        self.take("async")
        self.need("function")
        self.take("*")
        name = None
        if self.kind() == "name" and self.val() != "(":
            name = Node("identifier", self.start, self.toks[self.i][3])
            self.i += 1
        p = self.parameters()
        self.annotation({"{"})
        return self.done(kind, here, [("name", name), ("parameters", p), ("body", self.block())])

    def klass(self, kind: str) -> Node:
        here = self.start
        self.i += 1
        name = up = None
        if self.kind() == "name" and self.val() not in ("extends", "{"):
            name = Node("identifier", self.start, self.toks[self.i][3])
            self.i += 1
        if self.val() == "extends":
            at = self.start
            self.i += 1
            up = self.done("class_heritage", at, [(None, self.postfix())])
        at, parts = self.start, []
        self.need("{")
        while not self.take("}"):
            if self.take(";"):
                continue
            parts.append((None, self.member()))
        return self.done(kind, here, [("name", name), (None, up), ("body", self.done("class_body", at, parts))])

    def member(self) -> Node:
        here = self.start
        while self.val() in ("static", "async", "get", "set", "*") and self.val(1) not in ("(", "=", ";", ",", "}", ":"):
            self.i += 1
        k = self.key()
        if self.val() == "(":
            p = self.parameters()
            self.annotation({"{"})
            return self.done("method_definition", here, [("name", k), ("parameters", p), ("body", self.block())])
        self.annotation({"=", ";", "}"})
        value = self.expression() if self.take("=") else None
        self.semi()
        return self.done("field_definition", here, [("property", k), ("value", value)])

    def key(self) -> Node:
        here = self.start
        if self.take("["):
            e = self.expression()
            self.need("]")
            return self.done("computed_property_name", here, [(None, e)])
        if self.kind() in ("string", "number"):
            return self.primary()
        if self.kind() != "name":
            raise Bad
        self.i += 1
        return self.done("property_identifier", here, [])

    def imports(self) -> Node:
        here = self.start
        self.i += 1
        self.take("type")
        clause = None
        if self.kind() != "string":
            at, parts = self.start, []
            while self.val() != "from":
                if self.take(","):
                    continue
                p = self.start
                if self.take("*"):
                    self.need("as")
                    parts.append((None, self.done("namespace_import", p, [(None, self.pattern())])))
                elif self.val() == "{":
                    parts.append((None, self.specifiers("named_imports", "import_specifier")))
                else:
                    parts.append((None, self.pattern()))
            clause = self.done("import_clause", at, parts)
            self.need("from")
        source = self.primary()
        self.semi()
        return self.done("import_statement", here, [(None, clause), ("source", source)])

    def specifiers(self, kind: str, item: str) -> Node:
        here, parts = self.start, []
        self.need("{")
        while not self.take("}"):
            at, alias = self.start, None
            name = self.primary() if self.kind() == "string" else self.pattern()
            if self.take("as"):
                alias = self.pattern()
            parts.append((None, self.done(item, at, [("name", name), ("alias", alias)])))
            if not self.take(","):
                self.need("}")
                break
        return self.done(kind, here, parts)

    def exports(self) -> Node:
        here = self.start
        self.i += 1
        if self.take("*"):
            name = self.pattern() if self.take("as") else None
            self.need("from")
            source = self.primary()
            self.semi()
            return self.done("export_statement", here, [(None, name), ("source", source)])
        if self.val() == "{":
            clause = self.specifiers("export_clause", "export_specifier")
            source = self.primary() if self.take("from") else None
            self.semi()
            return self.done("export_statement", here, [(None, clause), ("source", source)])
        if self.take("default"):
            if self.val() in ("function", "class") or (self.val() == "async" and self.val(1) == "function"):
                return self.done("export_statement", here, [("declaration", self.statement())])
            value = self.expression()
            self.semi()
            return self.done("export_statement", here, [("value", value)])
        return self.done("export_statement", here, [("declaration", self.statement())])

    # -- expressions ---------------------------------------------------------------------------------------------------
    def paren(self) -> Node:
        here = self.start
        self.need("(")
        e = self.sequence()
        self.need(")")
        return self.done("parenthesized_expression", here, [(None, e)])

    def sequence(self, no_in: bool = False) -> Node:
        here, parts = self.start, [self.expression(no_in)]
        while self.take(","):
            parts.append(self.expression(no_in))
        return parts[0] if len(parts) == 1 else self.done("sequence_expression", here, [(None, p) for p in parts])

    def arrow(self) -> Node | None:
        """An arrow function, if one starts here."""
        here, at = self.start, self.i
        if self.val() == "async" and not (self.val(1) in ("=>", "", ".") or self.kind(1) == "mark" and self.val(1) != "("):
            self.i += 1
        if self.kind() == "name" and self.val(1) == "=>":
            p = ("parameter", self.pattern())
        elif self.val() == "(" and self._closes_before_arrow():
            p = ("parameters", self.parameters())
            self.annotation({"=>"})
        else:
            self.i = at
            return None
        self.need("=>")
        body = self.block() if self.val() == "{" else self.expression()
        return self.done("arrow_function", here, [p, ("body", body)])

    def _closes_before_arrow(self) -> bool:
        if self.closers is None:
            self.closers, open_ = {}, []
            for j, t in enumerate(self.toks):
                v = t[1] if t[0] == "mark" else ""
                if v in ("(", "[", "{"):
                    open_.append(j)
                elif v in (")", "]", "}") and open_:
                    self.closers[open_.pop()] = j
        j = self.closers.get(self.i)
        return j is not None and j + 1 < len(self.toks) and self.toks[j + 1][1] == "=>"

    def expression(self, no_in: bool = False) -> Node:
        here = self.start
        if (self.kind() == "name" or self.val() == "(") and (a := self.arrow()):
            return a
        left = self.binary(0, no_in)
        v = self.val()
        if v == "?":
            self.i += 1
            yes = self.expression()
            self.need(":")
            return self.done("ternary_expression", here, [("condition", left), ("consequence", yes), ("alternative", self.expression(no_in))])
        if v == "=":
            self.i += 1
            return self.done("assignment_expression", here, [("left", left), ("right", self.expression(no_in))])
        if v in ASSIGN:
            self.i += 1
            return self.done("augmented_assignment_expression", here, [("left", left), ("right", self.expression(no_in))])
        return left

    def binary(self, least: int, no_in: bool) -> Node:
        here, left = self.start, self.unary()
        while (p := BINARY.get(self.val(), 0)) > least and not (no_in and self.val() == "in"):
            op = self.next()[1]
            right = self.binary(p - (op == "**"), no_in)
            left = self.done("binary_expression", here, [("left", left), ("right", right)])
        return left

    def unary(self) -> Node:
        here, v = self.start, self.val()
        if v in ("!", "~", "+", "-", "typeof", "void", "delete"):
            self.i += 1
            return self.done("unary_expression", here, [("argument", self.unary())])
        if v in ("++", "--"):
            self.i += 1
            return self.done("update_expression", here, [("argument", self.unary())])
        if v in ("await", "yield") and self.kind(1) != "end" and self.val(1) not in (")", ",", ";", "=", "."):
            self.i += 1
            self.take("*")
            return self.done(v + "_expression", here, [(None, self.unary())])
        e = self.postfix()
        if self.val() in ("++", "--") and not self.toks[self.i][4]:
            self.i += 1
            return self.done("update_expression", here, [("argument", e)])
        return e

    def arguments(self) -> Node:
        here, parts = self.start, []
        self.need("(")
        while not self.take(")"):
            at = self.start
            if self.take("..."):
                parts.append((None, self.done("spread_element", at, [(None, self.expression())])))
            else:
                parts.append((None, self.expression()))
            if not self.take(","):
                self.need(")")
                break
        return self.done("arguments", here, parts)

    def postfix(self) -> Node:
        here = self.start
        if self.val() == "new" and self.val(1) != ".":
            self.i += 1
            made = self.primary()
            while self.val() in (".", "["):
                made = self.step(here, made)
            args = self.arguments() if self.val() == "(" else None
            e = self.done("new_expression", here, [("constructor", made), ("arguments", args)])
        else:
            e = self.primary()
        while self.i < len(self.toks) and (self.val() in (".", "?.", "[", "(") or self.kind() == "template"):
            e = self.step(here, e)
        return e

    def step(self, here: int, e: Node) -> Node:
        if self.kind() == "template":
            return self.done("call_expression", here, [("function", e), ("arguments", self.primary())])
        v = self.val()
        if v == "(":
            return self.done("call_expression", here, [("function", e), ("arguments", self.arguments())])
        if v == "?." and self.val(1) in ("(", "["):
            self.i += 1
            return self.step(here, e)
        self.i += 1
        if v == "[":
            at = self.sequence()
            self.need("]")
            return self.done("subscript_expression", here, [("object", e), ("index", at)])
        at = self.start
        if self.kind() != "name":
            raise Bad
        self.i += 1
        return self.done("member_expression", here, [("object", e), ("property", Node("property_identifier", at, self.last))])

    def primary(self) -> Node:
        here, kind, v = self.start, self.kind(), self.val()
        if kind == "string":
            _, _, a, b, _ = self.next()
            inner = [(None, Node("string_fragment", a + 1, b - 1))] if b - a > 2 else []
            return self.done("string", here, inner)
        if kind == "template":
            _, _, a, b, _ = self.next()
            parts, at = [], a + 1
            while at < b - 1:
                if self.text[at] == "\\":
                    at += 2
                elif self.text.startswith("${", at):
                    end = self._closing(at + 2, b)
                    inner = Parser(self.text, at + 2, end)
                    try:
                        e = inner.sequence() if inner.toks else None
                    except (Bad, RecursionError):
                        e = Node("ERROR", at + 2, end)
                    parts.append((None, Node("template_substitution", at, min(end + 1, b), [(None, e)] if e else [])))
                    at = end + 1
                else:
                    at += 1
            return self.done("template_string", here, parts)
        if kind in ("number", "regex"):
            self.i += 1
            return self.done(kind, here, [])
        if v == "(":
            return self.paren()
        if v == "function" or (v == "async" and self.val(1) == "function"):
            return self.function("function_expression")
        if v == "class":
            return self.klass("class")
        if v == "[":
            self.i += 1
            parts = []
            while not self.take("]"):
                if self.take(","):
                    continue
                at = self.start
                parts.append((None, self.done("spread_element", at, [(None, self.expression())]) if self.take("...") else self.expression()))
                if self.val() != "]":
                    self.need(",")
            return self.done("array", here, parts)
        if v == "{":
            return self.object()
        if kind == "name":
            self.i += 1
            return self.done(v if v in ("true", "false", "null", "this", "super", "undefined", "import") else "identifier", here, [])
        raise Bad

    def _closing(self, at: int, stop: int) -> int:
        depth = 1
        while at < stop:
            c = self.text[at]
            if c == "`":
                at = _template_end(self.text, at + 1, stop) - 1
            depth += (c == "{") - (c == "}")
            if depth == 0:
                return at
            at += 1
        return max(at - 1, 0)

    def object(self) -> Node:
        here, parts = self.start, []
        self.need("{")
        while not self.take("}"):
            at = self.start
            if self.take("..."):
                parts.append((None, self.done("spread_element", at, [(None, self.expression())])))
            elif self.kind() == "name" and self.val(1) in (",", "}", "="):
                self.i += 1
                p = self.done("shorthand_property_identifier", at, [])
                if self.take("="):
                    self.expression()
                parts.append((None, p))
            else:
                save = self.i
                k = self.key() if self.val() not in ("async", "get", "set", "*") or self.val(1) in (":", "(") else None
                if k is not None and self.take(":"):
                    parts.append((None, self.done("pair", at, [("key", k), ("value", self.expression())])))
                else:
                    self.i = save
                    parts.append((None, self.member()))
            if not self.take(","):
                self.need("}")
                break
        return self.done("object", here, parts)


def _place(root: Node, c: Node) -> None:
    """Puts a comment into the innermost node around it, in order."""
    node = root
    while True:
        inner = next((x for _, x in node.children if x.start <= c.start and c.end <= x.end and x.kind != "comment"), None)
        if inner is None:
            break
        node = inner
    at = sum(1 for _, x in node.children if x.start < c.start)
    node.children.insert(at, (None, c))


def parse(text: str) -> Node:
    return tree.deeply(lambda t: Parser(t).program(), text)


COLUMNS = "path string, id int, parent_id int, field string, kind string, sibling_ix int, siblings int, pre int, post int, depth int, start_byte int, end_byte int, start_line int, start_col int, end_line int, end_col int, text string"
SCHEMA = pa.schema([(c.split()[0], pa.int32() if c.split()[1] == "int" else pa.string()) for c in COLUMNS.split(", ")])


def rows(path: str, text: str) -> Iterator[dict]:
    return tree.rows(path, text, parse)


def nodes(files: DataFrame) -> DataFrame:
    """The rows of all trees of files (path, text): the one Python step between texts and findings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_pylist(list(rows(path, text or "")), schema=SCHEMA)

    return files.select("path", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, COLUMNS)

"""A tolerant parser for Object Pascal. Node kinds and field names are those that rules name."""

from __future__ import annotations

import re

from .tree import Bad, Node, Stream, deeply

WORDS = re.compile(r"(?P<space>\s+)|(?P<comment>//[^\n]*|\{[^}]*\}?|\(\*(?s:.*?)(?:\*\)|\Z))|(?P<string>(?:'(?:''|[^'\n])*'?|#\d+|#\$[\da-fA-F]+)+)|(?P<name>&?[^\W\d]\w*)|(?P<number>\$[\da-fA-F]+|\d+(?:\.(?!\.)\d+)?(?:[eE][+-]?\d+)?)|(?P<mark>:=|<>|<=|>=|\.\.|[()\[\],;:.+\-*/=<>^@])")
BINARY = {"=": 1, "<>": 1, "<": 1, ">": 1, "<=": 1, ">=": 1, "in": 1, "is": 1, "+": 2, "-": 2, "or": 2, "xor": 2, "*": 3, "/": 3, "div": 3, "mod": 3, "and": 3, "shl": 3, "shr": 3, "as": 3}
ROUTINES = {"procedure", "function", "constructor", "destructor", "operator"}
SECTIONS = ROUTINES | {"var", "const", "type", "begin", "implementation", "interface", "initialization", "finalization", "uses", "class", "threadvar", "resourcestring", "label", "exports"}
DIRECTIVES = {"overload", "override", "virtual", "stdcall", "cdecl", "forward", "external", "inline", "static", "abstract", "dynamic", "reintroduce", "register", "pascal", "safecall", "assembler", "message", "deprecated", "platform", "name", "final"}
CLOSERS = {"end", "until", "except", "finally", "else"}


class Pascal(Stream):
    def __init__(self, text: str):
        super().__init__(text, WORDS)
        self.declares = False  # in an interface part, where routines have no body

    def val(self, k: int = 0) -> str:
        return super().val(k).lower()

    def program(self) -> Node:
        return self.placed(Node("root", 0, len(self.text), [(None, s) for s in self.many(self.top, "", (";",))]))

    def top(self) -> Node | None:
        here, v = self.start, self.val()
        if self.take(";", ".", "end"):
            return None
        if v in ("program", "unit", "library", "package"):
            self.i += 1
            while self.i < len(self.toks) and not self.take(";"):
                self.i += 1
            return self.node("moduleName", here)
        if v in ("interface", "implementation", "initialization", "finalization"):
            self.i += 1
            self.declares = v == "interface"
            return None
        if v == "uses":
            return self.uses()
        if v == "type":
            return self.types()
        if v in ("var", "const", "threadvar", "resourcestring"):
            return self.variables()
        if v in ROUTINES or v == "class" and self.val(1) in ROUTINES:
            return self.routine()
        if v == "begin":
            return self.block()
        return self.statement()

    def uses(self) -> Node:
        here, names = self.start, []
        self.i += 1
        while self.i < len(self.toks) and not self.take(";"):
            if self.kind() == "name" and self.val() != "in":
                at = self.start
                self.i += 1
                while self.val() == "." and self.kind(1) == "name":
                    self.i += 2
                names.append((None, self.node("moduleName", at)))
            else:
                self.i += 1
        return self.node("declUses", here, *names)

    def types(self) -> Node:
        here, depth = self.start, 0
        self.i += 1
        while self.i < len(self.toks):
            v = self.val()
            if depth == 0 and v in SECTIONS and not (v in ("class", "interface", "procedure", "function") and self.val(-1) in ("=", "to", "packed", "reference")):
                break
            if v in ("record", "object") and self.val(-1) in ("=", "packed", ":") or v in ("class", "interface", "dispinterface") and self.val(-1) in ("=",) and self.val(1) not in (";", "of"):
                if not (v == "class" and self.val(1) == "(" and self._empty_heir()):
                    depth += 1
            elif v == "end":
                depth -= 1
            self.i += 1
        return self.node("declTypes", here)

    def _empty_heir(self) -> bool:
        j = self.i + 1
        while j < len(self.toks) and self.toks[j][1] != ")":
            j += 1
        return j + 1 < len(self.toks) and self.toks[j + 1][1] == ";"

    def variables(self) -> Node:
        here, word, parts = self.start, self.next()[1].lower(), []
        while self.kind() == "name" and self.val() not in SECTIONS and self.val() != "end":
            at, names = self.start, [self.name()]
            while self.take(","):
                names.append(self.name())
            kind = self.type() if self.take(":") else None
            value = self.expression() if self.take("=") else None
            while self.i < len(self.toks) and not self.take(";"):
                if self.val() in SECTIONS and self.val() != "class":
                    break
                self.i += 1
            parts.append((None, self.node("declConst" if word == "const" else "declVar", at, *(("name", n) for n in names), ("type", kind), ("defaultValue", value))))
        return self.node("declConsts" if word == "const" else "declVars", here, *parts)

    def type(self) -> Node:
        here = self.start
        if self.take("array"):
            if self.val() == "[":
                self.skip("[", "]")
            self.take("of")
            inner = self.type()
            return self.node("type", here, *inner.children)
        if self.take("set", "file"):
            self.take("of")
            return self.type()
        if self.take("^", "const", "packed"):
            return self.type()
        if self.val() == "(":
            self.skip("(", ")")
            return self.node("type", here)
        if self.val() in ROUTINES:
            self.i += 1
            if self.val() == "(":
                self.skip("(", ")")
            if self.take(":"):
                self.type()
            if self.val() == "of":
                self.i += 2
            return self.node("type", here)
        at = self.start
        first = self.name()
        while self.val() == "." and self.kind(1) == "name":
            self.i += 1
            first = self.name()
        if self.val() == "<":
            self.skip("<", ">")
        if self.val() == "[":
            self.skip("[", "]")
        if self.take(".."):
            self.expression()
        return self.node("type", here, (None, self.node("typeref", at, (None, first))))

    def header(self) -> Node:
        here = self.start
        self.take("class")
        word = self.next()[1].lower()
        name, at = None, self.start
        if self.kind() == "name":
            name = self.name()
            while self.take("."):
                name = self.name()
            if self.val() == "<":
                self.skip("<", ">")
        args = self.arguments_declared() if self.val() == "(" else None
        kind = self.type() if word in ("function", "operator") and self.take(":") else None
        del at
        return self.node("declProc", here, ("name", name), ("args", args), ("type", kind))

    def arguments_declared(self) -> Node:
        here, parts = self.start, []
        self.need("(")
        while self.i < len(self.toks) and self.val() != ")":
            at = self.start
            if self.val() == "[":
                self.skip("[", "]")
            while self.val() in ("const", "var", "out"):
                self.i += 1
            names = [self.name()]
            while self.take(","):
                names.append(self.name())
            kind = self.type() if self.take(":") else None
            value = self.expression(1) if self.take("=") else None
            parts.append((None, self.node("declArg", at, *(("name", n) for n in names), ("type", kind), ("defaultValue", value))))
            if not self.take(";"):
                break
        self.need(")")
        return self.node("declArgs", here, *parts)

    def routine(self) -> Node:
        here, head, bodiless = self.start, self.header(), self.declares
        self.take(";")
        while self.val() in DIRECTIVES:
            bodiless |= self.val() in ("forward", "external", "abstract")
            while self.i < len(self.toks) and not self.take(";"):
                self.i += 1
        if bodiless:
            return head
        local, body = [], None
        while self.i < len(self.toks):
            v = self.val()
            if v == "begin" or v == "asm":
                body = self.block()
                self.take(";")
                break
            if v in ("var", "const", "threadvar"):
                local.append((None, self.variables()))
            elif v == "type":
                local.append((None, self.types()))
            elif v in ROUTINES:
                local.append((None, self.routine()))
            elif v == "label":
                while self.i < len(self.toks) and not self.take(";"):
                    self.i += 1
            else:
                break
        return self.node("defProc", here, ("header", head), *local, ("body", body))

    def statements(self, *closers: str) -> list[Node]:
        out: list[Node] = []
        while self.i < len(self.toks) and self.val() not in closers:
            at = self.i
            out += self.many(self.statement, closers[0], (";", *closers)) if len(closers) == 1 else self._until(closers)
            if self.i == at:
                self.i += 1
        return out

    def _until(self, closers: tuple) -> list[Node]:
        def one() -> Node | None:
            return self.statement()

        out: list[Node] = []
        while self.i < len(self.toks) and self.val() not in closers:
            at, here = self.i, self.start
            try:
                found = one()
            except (Bad, RecursionError):
                self.i = max(self.i, at + 1)
                while self.i < len(self.toks) and self.val() not in (";", *closers):
                    self.i += 1
                found = Node("ERROR", here, self.last)
            if found is not None:
                out.append(found)
            if self.i == at:
                self.i += 1
        return out

    def block(self) -> Node:
        here = self.start
        if self.take("asm"):
            while self.i < len(self.toks) and not self.take("end"):
                self.i += 1
            return self.node("asm", here)
        self.need("begin")
        body = self._until(("end",))
        self.take("end")
        return self.node("block", here, *((None, s) for s in body))

    def statement(self) -> Node | None:
        here, v = self.start, self.val()
        if self.take(";"):
            return None
        if v in ("begin", "asm"):
            return self.block()
        if v in CLOSERS or self.kind() == "end":
            return None
        read = getattr(self, f"s_{v}", None) if self.kind() == "name" else None
        if read:
            self.i += 1
            return read(here)
        if v in ("var", "const") and self.kind(1) == "name":
            self.i += 1
            target = self.name()
            kind = self.type() if self.take(":") else None
            value = self.expression() if self.take(":=", "=") else None
            return self.node("assignment", here, ("lhs", target), ("type", kind), ("rhs", value)) if value else self.node("varDef", here, (None, target))
        if v == "goto":
            self.i += 1
            return self.node("goto", here, (None, self.leaf("identifier")))
        if self.kind() in ("name", "number") and self.val(1) == ":" and self.val(2) != "=":
            self.i += 2
            return self.node("label", here)
        e = self.expression()
        if self.take(":="):
            e = self.node("assignment", here, ("lhs", e), ("rhs", self.expression()))
            self.take(";")
            return e
        self.take(";")
        return self.node("statement", here, (None, e))

    def s_if(self, here: int) -> Node:
        test = self.expression()
        self.need("then")
        yes = self.statement()
        no = self.statement() if self.take("else") else None
        return self.node("ifElse" if no else "if", here, ("condition", test), ("then", yes), ("else", no))

    def s_while(self, here: int) -> Node:
        test = self.expression()
        self.need("do")
        return self.node("while", here, ("condition", test), ("body", self.statement()))

    def s_for(self, here: int) -> Node:
        self.take("var")
        at, target = self.start, self.name()
        if self.take(":"):
            self.type()
        first = None
        if self.take(":=", "in"):
            first = self.node("assignment", at, ("lhs", target), ("rhs", self.expression()))
        end = self.expression() if self.take("to", "downto") else None
        self.need("do")
        return self.node("for", here, ("start", first), ("end", end), ("body", self.statement()))

    def s_repeat(self, here: int) -> Node:
        body = self._until(("until",))
        self.need("until")
        return self.node("repeat", here, *((None, s) for s in body), ("condition", self.expression()))

    def s_case(self, here: int) -> Node:
        parts: list = [(None, self.expression())]
        self.need("of")
        while self.i < len(self.toks) and self.val() != "end":
            if self.take(";"):
                continue
            if self.take("else"):
                parts += [(None, s) for s in self._until(("end",))]
                break
            while self.i < len(self.toks) and self.val() not in (":", "end"):
                self.i += 1
            self.need(":")
            parts.append((None, self.statement()))
        self.take("end")
        return self.node("case", here, *parts)

    def s_with(self, here: int) -> Node:
        parts = [("entity", self.expression())]
        while self.take(","):
            parts.append(("entity", self.expression()))
        self.need("do")
        return self.node("with", here, *parts, ("body", self.statement()))

    def s_raise(self, here: int) -> Node:
        value = None if self.val() in (";", "end", "else") else self.expression()
        return self.node("raise", here, (None, value))

    def s_inherited(self, here: int) -> Node:
        return self.node("inherited", here, (None, None if self.val() in (";", "end", "else") else self.expression()))

    def s_try(self, here: int) -> Node:
        at = self.start
        body = self.node("statements", at, *((None, s) for s in self._until(("except", "finally", "end"))))
        parts: list = [("try", body)]
        word = self.val()
        if word in ("except", "finally"):
            parts.append((None, self.leaf("kExcept" if word == "except" else "kFinally")))
            at = self.start
            handlers, plain = [], []
            while self.i < len(self.toks) and self.val() != "end":
                if self.val() == "on" and word == "except":
                    handlers.append(("except", self.handler()))
                elif self.take("else"):
                    plain += self._until(("end",))
                else:
                    found = self._until(("end", "on", "else"))
                    plain += found
            parts += handlers
            if plain:
                parts.append((word, Node("statements", plain[0].start, self.last, [(None, s) for s in plain])))
        parts.append((None, self.leaf("kEnd")) if self.val() == "end" else (None, None))
        return self.node("try", here, *parts)

    def handler(self) -> Node:
        here = self.start
        self.need("on")
        name = self.name()
        kind = self.type() if self.take(":") else None
        self.need("do")
        body = self.statement()
        self.take(";")
        return self.node("exceptionHandler", here, ("variable", name), ("exception", kind), ("body", body))

    # -- expressions -------------------------------------------------------------------------------------------------
    def expression(self, least: int = 0) -> Node:
        here, left = self.start, self.unary()
        while (power := BINARY.get(self.val(), 0)) > least:
            self.i += 1
            left = self.node("exprBinary", here, ("lhs", left), ("rhs", self.expression(power)))
        return left

    def unary(self) -> Node:
        here = self.start
        if self.take("not", "-", "+", "@"):
            return self.node("exprUnary", here, ("operand", self.unary()))
        if self.take("inherited"):
            return self.node("inherited", here, (None, self.unary() if self.kind() == "name" else None))
        e = self.primary()
        while True:
            if self.val() == "." and self.kind(1) == "name":
                self.i += 1
                e = self.node("exprDot", here, ("lhs", e), ("rhs", self.name()))
            elif self.val() == "(":
                e = self.node("exprCall", here, ("entity", e), ("args", self.listed("exprArgs", "(", ")")))
            elif self.val() == "[":
                e = self.node("exprSubscript", here, ("entity", e), ("args", self.listed("exprArgs", "[", "]")))
            elif self.take("^"):
                e = self.node("exprDeref", here, ("entity", e))
            else:
                return e

    def listed(self, kind: str, opener: str, closer: str) -> Node:
        here, parts = self.start, []
        self.need(opener)
        while self.i < len(self.toks) and self.val() != closer:
            if not self.take(",", "..", ":"):
                at = self.i
                parts.append((None, self.expression()))
                if self.take(":="):
                    parts.append((None, self.expression()))
                if self.i == at:
                    raise Bad
        self.need(closer)
        return self.node(kind, here, *parts)

    def primary(self) -> Node:
        here, k, v = self.start, self.kind(), self.val()
        if k == "string":
            return self.leaf("literalString")
        if k == "number":
            return self.leaf("literalNumber")
        if v == "(":
            return self.listed("exprParens", "(", ")")
        if v == "[":
            return self.listed("exprBrackets", "[", "]")
        if v in ("true", "false", "nil"):
            return self.leaf("k" + v.capitalize())
        if v in ("procedure", "function"):
            self.i += 1
            args = self.arguments_declared() if self.val() == "(" else None
            if self.take(":"):
                self.type()
            while self.val() in ("var", "const"):
                self.variables()
            return self.node("lambda", here, ("args", args), ("body", self.block()))
        if k == "name" and v not in CLOSERS | {"begin", "then", "do", "of", "to", "downto"}:
            return self.name()
        raise Bad


def pascal(text: str) -> Node:
    return deeply(lambda t: Pascal(t).program(), text)

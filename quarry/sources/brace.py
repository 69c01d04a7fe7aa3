"""Tolerant parsers for Go, C# and Rust over one expression parser. Node kinds and field names are those that rules name."""

from __future__ import annotations

import re

from .tree import Bad, Node, Stream, deeply

NAME = r"(?P<name>@?[^\W\d]\w*|r#\w+)"
SPACE = r"(?P<space>\s+)"
COMMENT = r"(?P<comment>//[^\n]*|/\*(?s:.*?)(?:\*/|\Z))"
NUMBER = r"(?P<number>0[xXbBoO][\da-fA-F_]+\w*|\d[\d_]*(?:\.(?!\.)\d[\d_]*)?(?:[eE][+-]?\d+)?\w*)"
MARK = r"(?P<mark>>>=|<<=|&\^=|\.\.\.|\.\.=|\?\?=|&&|\|\||\?\?|\?\.|::|=>|->|<-|:=|==|!=|<=|>=|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\.\.|[{}()\[\];,<>+\-*/%&|^!~?:=.@#$'])"
BINARY = {"??": 1, "||": 2, "&&": 3, "==": 4, "!=": 4, "<": 5, ">": 5, "<=": 5, ">=": 5, "is": 5, "as": 9, "|": 6, "^": 6, "&": 7, "<<": 8, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "..": 1, "..=": 1}
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "&^=", "??="}


class Brace(Stream):
    """What the three languages share. Subclasses name their kinds and read their statements."""

    WORDS: re.Pattern
    ROOT = "source_file"
    MEMBER, CALL, ARGUMENTS, INDEX, STRING = ("selector_expression", "operand", "field"), "call_expression", "argument_list", "index_expression", "interpreted_string_literal"
    PROPERTY = "field_identifier"
    PREFIX = {"-", "+", "!", "~", "&", "*", "++", "--", "<-", "^"}
    WORD_PREFIX: set = set()
    STATEMENTS: dict = {}

    def __init__(self, text: str):
        super().__init__(text, self.WORDS)
        self.headed = False  # in the head of a statement, where { begins its block

    def program(self) -> Node:
        return self.placed(Node(self.ROOT, 0, len(self.text), [(None, s) for s in self.many(self.top, "")]))

    def top(self) -> Node | None:
        return self.statement()

    def block(self, kind: str = "block") -> Node:
        here, headed, self.headed = self.start, self.headed, False
        self.need("{")
        body = self.many(self.statement, "}")
        self.take("}")
        self.headed = headed
        return self.node(kind, here, *((None, s) for s in body))

    def head(self) -> Node | None:
        """The expressions between a statement's keyword and its block."""
        here, headed, self.headed, parts = self.start, self.headed, True, []
        while self.i < len(self.toks) and self.val() != "{":
            if self.take(";", ","):
                continue
            parts.append(self.simple())
        self.headed = headed
        return self.node("condition", here, *((None, p) for p in parts)) if parts else None

    def simple(self) -> Node:
        return self.expression()

    def statement(self) -> Node | None:
        if self.take(";"):
            return None
        if self.val() == "{":
            return self.block()
        read = self.STATEMENTS.get(self.val()) if self.kind() == "name" else None
        if read:
            return getattr(self, read)()
        here, e = self.start, self.simple()
        self.take(";")
        return self.node("expression_statement", here, (None, e)) if e.kind not in ("short_var_declaration", "assignment_statement") else e

    def controlled(self) -> Node:
        """if, for, while, switch, match and the like: a head, blocks, and more of both after else."""
        here, word = self.start, self.next()[1]
        parts: list = [("condition", self.head())]
        if self.val() == "{":
            parts.append(("body", self.block()))
        if self.take("else"):
            parts.append(("alternative", self.statement()))
        return self.node(f"{word}_statement", here, *parts)

    def returned(self) -> Node:
        here, word = self.start, self.next()[1]
        value = None if self.val() in (";", "}") or self.fresh and self.MEMBER[0] == "selector_expression" or self.kind() == "end" else self.values()
        self.take(";")
        return self.node(self.RETURN if word == "return" else f"{word}_statement", here, (None, value))

    RETURN = "return_statement"

    def values(self) -> Node:
        return self.expression()

    # -- expressions -------------------------------------------------------------------------------------------------
    def expression(self, least: int = 0) -> Node:
        here, left = self.start, self.unary()
        while True:
            v = self.val()
            if v in ASSIGN and least == 0:
                self.i += 1
                left = self.node("assignment_expression" if v == "=" or self.MEMBER[0] != "field_expression" else "compound_assignment_expr", here, ("left", left), ("right", self.expression()))
            elif v == "?" and least == 0 and self.MEMBER[0] == "member_access_expression":
                self.i += 1
                yes = self.expression()
                self.need(":")
                left = self.node("conditional_expression", here, (None, left), (None, yes), (None, self.expression()))
            elif (power := BINARY.get(v, 0)) > least and not (v in ("is", "as") and self.kind() != "name") and not (v in ("..", "..=") and self.val(1) in (")", "]", "{", ",", "")and self.kind(1) in ("mark", "end")):
                self.i += 1
                if v in ("is", "as"):
                    self.type()
                    left = self.node("cast_expression", here, (None, left))
                else:
                    left = self.node("binary_expression", here, ("left", left), ("right", self.expression(power)))
            else:
                return left

    def unary(self) -> Node:
        here, v = self.start, self.val()
        if v in self.PREFIX or v in self.WORD_PREFIX:
            self.i += 1
            if v == "&":
                self.take("mut")
                return self.node("reference_expression" if self.MEMBER[0] == "field_expression" else "unary_expression", here, ("value", self.unary()))
            return self.node("unary_expression", here, (None, self.unary()))
        return self.postfix(self.primary())

    def postfix(self, e: Node) -> Node:
        while True:
            here, v = e.start, self.val()
            if v in (".", "?."):
                self.i += 1
                if self.val() == "(":  # a type assertion
                    self.skip("(", ")")
                    e = self.node("type_assertion_expression", here, ("operand", e))
                elif self.kind() == "number":
                    self.i += 1
                    e = self.node(self.MEMBER[0], here, (self.MEMBER[1], e))
                else:
                    e = self.node(self.MEMBER[0], here, (self.MEMBER[1], e), (self.MEMBER[2], self.name(self.PROPERTY)))
                    self.generics()
            elif v == "(":
                e = self.node(self.CALL, here, ("function", e), ("arguments", self.arguments()))
            elif v == "[":
                self.i += 1
                parts = []
                while self.i < len(self.toks) and self.val() != "]":
                    if not self.take(",", ":", "..", "^"):
                        parts.append((None, self.expression()))
                self.need("]")
                e = self.node(self.INDEX, here, ("operand", e), *parts)
            elif v in ("++", "--") or v == "?" and self.MEMBER[0] == "field_expression" or v == "!" and self.MEMBER[0] == "member_access_expression":
                self.i += 1
                e = self.node({"?": "try_expression", "!": "postfix_unary_expression"}.get(v, "inc_statement"), here, (None, e))
            else:
                more = self.trailer(e)
                if more is None:
                    return e
                e = more

    def trailer(self, e: Node) -> Node | None:
        return None

    def generics(self) -> None:
        pass

    def arguments(self, kind: str | None = None, opener: str = "(", closer: str = ")") -> Node:
        here, headed, self.headed, parts = self.start, self.headed, False, []
        self.need(opener)
        while self.i < len(self.toks) and self.val() != closer:
            if not self.take(",", ";"):
                at = self.i
                parts.append((None, self.argument()))
                if self.i == at:
                    raise Bad
        self.need(closer)
        self.headed = headed
        return self.node(kind or self.ARGUMENTS, here, *parts)

    def argument(self) -> Node:
        return self.expression()

    def primary(self) -> Node:
        k, v = self.kind(), self.val()
        if k == "string":
            return self.string()
        if k == "number":
            return self.leaf("number_literal")
        if v == "(":
            here = self.start
            parts = self.arguments("parenthesized_expression")
            return self.node("parenthesized_expression", here, *parts.children)
        if k == "name":
            return self.word()
        raise Bad

    def string(self) -> Node:
        t = self.toks[self.i]
        inner = re.match(r"""[a-zA-Z@$]*(#*["'`]{1,3})""", t[1])
        a = len(inner[0]) if inner else 1
        b = len(t[1]) - (len(inner[1]) if inner and t[1].endswith(inner[1][::-1]) else 0)
        self.i += 1
        content = [(None, Node("string_content", t[2] + a, t[2] + b))] if b > a else []
        return Node(self.STRING, t[2], t[3], content)

    def word(self) -> Node:
        if self.val() in ("true", "false", "nil", "null"):
            return self.leaf(self.val())
        return self.name()

    def type(self) -> Node:
        """Past a type: names, dots, and what brackets hold."""
        here, at = self.start, self.i
        while self.take("*", "&", "[", "]", "mut", "dyn", "impl", "ref", "out", "in", "params", "this", "...", "const", "readonly", "chan", "<-", "'"):
            pass
        if self.val() in ("func", "fn"):
            self.i += 1
            self.skip("(", ")")
            if self.val() == "(":
                self.skip("(", ")")
        elif self.val() in ("struct", "interface") and self.val(1) == "{":
            self.i += 1
            self.skip("{", "}")
        elif self.val() == "map" and self.val(1) == "[":
            self.i += 1
            self.skip("[", "]")
            self.type()
        elif self.val() == "(":
            self.skip("(", ")")
        elif self.kind() == "name" or self.kind() == "number":
            self.i += 1
            while self.val() in (".", "::") and self.kind(1) == "name":
                self.i += 2
            if self.val() == "<":
                self.angle()
            while self.val() == "[" and self.val(1) in ("]", ","):
                self.skip("[", "]")
            self.take("?")
        if self.i == at:
            raise Bad
        return self.node("type", here)

    def angle(self) -> None:
        level = 0
        while self.i < len(self.toks):
            v = self.val()
            level += (v == "<") - (v == ">")
            if v in (";", "{", "}", ")") and v != ")" or self.kind() == "string":
                raise Bad
            self.i += 1
            if level == 0:
                return


class Go(Brace):
    WORDS = re.compile(rf'{SPACE}|{COMMENT}|(?P<string>"(?:\\.|[^"\\\n])*"?|`[^`]*`?|\'(?:\\.|[^\'\\\n])+\')|{NAME}|{NUMBER}|{MARK}')
    STATEMENTS = {"func": "function", "import": "imports", "var": "variables", "const": "variables", "return": "returned", "if": "controlled", "for": "controlled", "switch": "controlled", "select": "controlled", "go": "later", "defer": "later", "type": "declared", "package": "package", "case": "case", "default": "case", "break": "jump", "continue": "jump", "goto": "jump", "fallthrough": "jump"}

    def package(self) -> Node:
        here = self.start
        self.i += 1
        return self.node("package_clause", here, (None, self.name("package_identifier")))

    def jump(self) -> Node:
        here, word = self.start, self.next()[1]
        if self.kind() == "name" and not self.fresh:
            self.i += 1
        return self.node(f"{word}_statement", here)

    def imports(self) -> Node:
        here, specs = self.start, []
        self.i += 1
        grouped = self.take("(")
        while self.i < len(self.toks) and not (grouped and self.take(")")):
            at, alias = self.start, None
            if self.take(";"):
                continue
            if self.val() in (".", "_") or self.kind() == "name":
                alias = self.leaf("package_identifier")
            if self.kind() != "string":
                raise Bad
            specs.append(self.node("import_spec", at, ("name", alias), ("path", self.string())))
            if not grouped:
                break
        return self.node("import_declaration", here, *((None, s) for s in specs))

    def parameters(self) -> Node:
        here, out = self.start, []
        self.need("(")
        while self.i < len(self.toks) and self.val() != ")":
            at, names = self.start, []
            while self.kind() == "name" and self.val(1) == "," or self.kind() == "name" and self.val() not in ("func", "map", "chan", "struct", "interface") and not names and self.val(1) not in (".", ",", ")"):
                names.append(self.name())
                if not self.take(","):
                    break
            if self.kind() == "name" and names and self.val(1) not in (",", ")", ".", "[", "{", "(") and self.toks[self.i - 1][1] == ",":
                names.append(self.name())
            kind = self.type()
            if self.val() == "{":
                self.skip("{", "}")
            out.append(self.node("parameter_declaration", at, *(("name", n) for n in names), ("type", kind)))
            if not self.take(","):
                break
        self.need(")")
        return self.node("parameter_list", here, *((None, p) for p in out))

    def function(self) -> Node:
        here = self.start
        self.i += 1
        receiver = self.parameters() if self.val() == "(" and self.kind(1) != "end" and self._method() else None
        if receiver is None and self.val() == "(":
            return self.literal(here)
        name = self.name("field_identifier" if receiver else "identifier")
        if self.val() == "[":
            self.skip("[", "]")
        params = self.parameters()
        self.result()
        body = self.block() if self.val() == "{" else None
        return self.node("method_declaration" if receiver else "function_declaration", here, ("receiver", receiver), ("name", name), ("parameters", params), ("body", body))

    def _method(self) -> bool:
        level = 0
        for j in range(self.i, len(self.toks)):
            v = self.toks[j][1] if self.toks[j][0] == "mark" else ""
            level += (v == "(") - (v == ")")
            if level == 0:
                return j + 2 < len(self.toks) and self.toks[j + 1][0] == "name" and self.toks[j + 2][1] == "("
        return False

    def result(self) -> None:
        if self.val() == "(":
            self.skip("(", ")")
        elif self.val() != "{" and not self.fresh:
            self.type()

    def literal(self, here: int) -> Node:
        params = self.parameters()
        self.result()
        return self.postfix(self.node("func_literal", here, ("parameters", params), ("body", self.block())))

    def variables(self) -> Node:
        here, specs = self.start, []
        word = self.next()[1]
        grouped = self.take("(")
        while self.i < len(self.toks) and not (grouped and self.take(")")):
            at, names = self.start, [self.name()]
            while self.take(","):
                names.append(self.name())
            if self.val() != "=" and not self.fresh:
                self.type()
            value = self.values() if self.take("=") else None
            specs.append(self.node("const_spec" if word == "const" else "var_spec", at, *(("name", n) for n in names), ("value", value)))
            self.take(";")
            if not grouped:
                break
        return self.node(f"{word}_declaration", here, *((None, s) for s in specs))

    def declared(self) -> Node:
        here = self.start
        self.i += 1
        while self.i < len(self.toks) and self.val() != "{" and not self.fresh:
            self.i += 1
        if self.val() == "{":
            self.skip("{", "}")
        return self.node("type_declaration", here)

    def later(self) -> Node:
        here, word = self.start, self.next()[1]
        return self.node(f"{word}_statement", here, (None, self.expression()))

    def case(self) -> Node:
        here, word, parts = self.start, self.next()[1], []
        while word == "case" and self.i < len(self.toks) and self.val() != ":":
            if not self.take(","):
                parts.append((None, self.simple()))
        self.take(":")
        return self.node("expression_case", here, *parts)

    def values(self) -> Node:
        here, parts = self.start, [self.expression(1 - 1)]
        while self.take(","):
            parts.append(self.expression())
        return self.node("expression_list", here, *((None, p) for p in parts))

    def simple(self) -> Node:
        here = self.start
        if self.take("range"):
            return self.node("range_clause", here, ("right", self.expression()))
        parts = [self.expression(0.5)]
        while self.take(","):
            parts.append(self.expression(0.5))
        v = self.val()
        if v == ":=" or v in ASSIGN:
            left = Node("expression_list", here, self.last, [(None, p) for p in parts])
            self.i += 1
            self.take("range")
            return self.node("short_var_declaration" if v == ":=" else "assignment_statement", here, ("left", left), ("right", self.values()))
        if v == "<-":
            self.i += 1
            return self.node("send_statement", here, (None, parts[0]), (None, self.expression()))
        if v == ":" and not self.headed and len(parts) == 1 and parts[0].kind == "identifier":
            self.i += 1
            return self.node("labeled_statement", here)
        return parts[0] if len(parts) == 1 else self.node("expression_list", here, *((None, p) for p in parts))

    def argument(self) -> Node:
        if self.val() in ("[", "map", "chan", "struct", "*") and self.val() != "*":
            return self.postfix(self.primary())
        e = self.expression()
        self.take("...")
        return e

    def word(self) -> Node:
        here = self.start
        if self.take("func"):
            return self.literal(here)
        if self.val() in ("map", "struct", "interface", "chan"):
            return self.made(here, self.type())
        return super().word()

    def primary(self) -> Node:
        here = self.start
        if self.val() == "[":
            self.skip("[", "]")
            return self.made(here, self.type())
        return super().primary()

    def made(self, here: int, kind: Node) -> Node:
        if self.val() == "{":
            return self.node("composite_literal", here, ("type", kind), ("body", self.elements()))
        return kind

    def elements(self) -> Node:
        here, headed, self.headed, parts = self.start, self.headed, False, []
        self.need("{")
        while self.i < len(self.toks) and self.val() != "}":
            if self.take(","):
                continue
            at = self.start
            key = self.element()
            if self.take(":"):
                key = self.node("keyed_element", at, (None, key), (None, self.element()))
            parts.append((None, key))
        self.need("}")
        self.headed = headed
        return self.node("literal_value", here, *parts)

    def element(self) -> Node:
        here = self.start
        e = self.elements() if self.val() == "{" else self.expression()
        return self.node("literal_element", here, (None, e))

    def trailer(self, e: Node) -> Node | None:
        named = e.kind in ("identifier", "selector_expression", "type")
        if self.val() == "{" and named and not self.headed and self.text[e.end : self.start].strip() == "" and re.search(r"(^|\.)[A-Z]\w*$", self.text[e.start : e.end]):
            return self.node("composite_literal", e.start, ("type", e), ("body", self.elements()))
        return None


class CSharp(Brace):
    WORDS = re.compile(rf'{SPACE}|{COMMENT}|(?P<space2>\A\Z)|(?P<string>(?:\$@|@\$|@)"(?:""|[^"])*"?|\$?"""(?s:.*?)"""|\$?"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])+\')|{NAME}|{NUMBER}|{MARK}')
    ROOT, STRING, PROPERTY = "compilation_unit", "string_literal", "identifier"
    MEMBER, CALL, INDEX = ("member_access_expression", "expression", "name"), "invocation_expression", "element_access_expression"
    WORD_PREFIX = {"await", "throw", "ref", "out", "in", "checked", "unchecked"}
    MODIFIERS = {"public", "private", "protected", "internal", "static", "async", "override", "virtual", "sealed", "abstract", "readonly", "partial", "extern", "unsafe", "new", "const", "volatile", "required", "file"}
    STATEMENTS = {"using": "used", "namespace": "space", "class": "held", "struct": "held", "interface": "held", "record": "held", "enum": "enumerated", "return": "returned", "yield": "jump", "if": "controlled", "while": "controlled", "for": "controlled", "foreach": "controlled", "switch": "controlled", "lock": "controlled", "fixed": "controlled", "do": "controlled", "try": "tried", "break": "jump", "continue": "jump", "goto": "jump", "case": "case", "default": "case"}

    def used(self) -> Node:
        here = self.start
        self.i += 1
        if self.val() == "(":
            head = self.arguments("condition")
            return self.node("using_statement", here, ("condition", head), ("body", self.statement()))
        if self.val() in ("var",) or self.kind(1) == "name":
            self.take("static", "global")
            if self._typed():
                d = self.variables(here)
                return d
        alias = None
        if self.val(1) == "=":
            alias = self.name()
            self.i += 1
        path = self.expression(1)
        self.take(";")
        return self.node("using_directive", here, ("alias", alias), ("name", path))

    def space(self) -> Node:
        here = self.start
        self.i += 1
        path = self.expression(1)
        body = self.block("declaration_list") if self.val() == "{" else None
        self.take(";")
        return self.node("namespace_declaration", here, ("name", path), ("body", body))

    def held(self) -> Node:
        here, word = self.start, self.next()[1]
        self.take("class", "struct")
        name = self.name()
        while self.i < len(self.toks) and self.val() not in ("{", ";"):
            self.skip("(", ")") if self.val() == "(" else self.next()
        body = self.members(name) if self.val() == "{" else None
        self.take(";")
        return self.node(f"{word}_declaration", here, ("name", name), ("body", body))

    def enumerated(self) -> Node:
        here = self.start
        self.i += 1
        name = self.name()
        while self.i < len(self.toks) and self.val() != "{":
            self.i += 1
        self.skip("{", "}")
        return self.node("enum_declaration", here, ("name", name))

    def members(self, owner: Node) -> Node:
        here = self.start
        self.need("{")
        body = self.many(self.member, "}")
        self.take("}")
        return self.node("declaration_list", here, *((None, m) for m in body))

    def member(self) -> Node | None:
        if self.take(";"):
            return None
        here = self.start
        while self.val() == "[":
            self.skip("[", "]")
        while self.val() in self.MODIFIERS:
            self.i += 1
        if self.val() in ("class", "struct", "interface", "record") or self.val() == "enum":
            return self.enumerated() if self.val() == "enum" else self.held()
        if self.take("event", "delegate", "implicit", "explicit"):
            while self.i < len(self.toks) and not self.take(";"):
                self.i += 1
            return self.node("event_declaration", here)
        if self.kind() == "name" and self.val(1) == "(" or self.val() == "~":
            self.take("~")
            return self.method(here, "constructor_declaration")
        self.type()
        if self.val() == "(":
            raise Bad
        self.take("operator")
        if self.val() == "this":
            self.i += 1
            self.skip("[", "]")
        elif self.val(1) in ("(", "<") or self.val(1) == ".":
            while self.val(1) == ".":
                self.i += 2
            return self.method(here, "method_declaration")
        names = [self.declarator()]
        while self.take(","):
            names.append(self.declarator())
        if self.val() in ("{", "=>"):
            body = self.block() if self.val() == "{" else self.arrowed()
            value = self.expression() if self.take("=") else None
            self.take(";")
            return self.node("property_declaration", here, *names[0].children, ("accessors", body), ("value", value))
        self.take(";")
        return self.node("field_declaration", here, *((None, n) for n in names))

    def method(self, here: int, kind: str) -> Node:
        name = self.name()
        if self.val() == "<":
            self.angle()
        params = self.parameters()
        while self.i < len(self.toks) and self.val() not in ("{", "=>", ";"):
            self.skip("(", ")") if self.val() == "(" else self.next()
        body = self.block() if self.val() == "{" else self.arrowed() if self.val() == "=>" else None
        self.take(";")
        return self.node(kind, here, ("name", name), ("parameters", params), ("body", body))

    def arrowed(self) -> Node:
        here = self.start
        self.need("=>")
        return self.node("arrow_expression_clause", here, (None, self.expression()))

    def parameters(self) -> Node:
        here, out = self.start, []
        self.need("(")
        while self.i < len(self.toks) and self.val() != ")":
            while self.val() == "[":
                self.skip("[", "]")
            at, kind = self.start, None
            if self.val(1) not in (",", ")"):
                kind = self.type()
            name = self.name()
            value = self.expression() if self.take("=") else None
            out.append(self.node("parameter", at, ("type", kind), ("name", name), (None, value)))
            if not self.take(","):
                break
        self.need(")")
        return self.node("parameter_list", here, *((None, p) for p in out))

    def _typed(self) -> bool:
        """Whether a declaration (type, then a name, then one of = ; , : in) starts here."""
        at = self.i
        try:
            self.type()
            return self.kind() == "name" and self.val() not in ("is", "as", "in") and self.val(1) in ("=", ";", ",", "in", ")", "(", "<") and not (self.val(1) == "<")
        except Bad:
            return False
        finally:
            self.i = at

    def variables(self, here: int) -> Node:
        kind, names = self.type(), [self.declarator()]
        while self.take(","):
            names.append(self.declarator())
        self.take(";")
        return self.node("local_declaration_statement", here, ("type", kind), *((None, n) for n in names))

    def declarator(self) -> Node:
        here, name = self.start, self.name()
        return self.node("variable_declarator", here, ("name", name), ("value", self.expression() if self.take("=") else None))

    def controlled(self) -> Node:
        here, word = self.start, self.next()[1]
        parts: list = []
        if word == "do":
            parts.append(("body", self.statement()))
            self.take("while")
        if self.val() == "(":
            parts.append(("condition", self.head()))
        if word in ("switch",) and self.val() == "{":
            parts.append(("body", self.block()))
        elif word != "do":
            parts.append(("body", self.statement()))
        if self.take("else"):
            parts.append(("alternative", self.statement()))
        return self.node(f"{word}_statement", here, *parts)

    def head(self) -> Node:
        here = self.start
        self.need("(")
        parts = []
        while self.i < len(self.toks) and self.val() != ")":
            if self.take(";", ","):
                continue
            at = self.start
            if self._typed():
                self.type()
                d = self.declarator()
                if self.take("in"):
                    d = self.node("variable_declarator", at, *d.children, ("value", self.expression()))
                parts.append(d)
            else:
                parts.append(self.expression())
        self.need(")")
        return self.node("condition", here, *((None, p) for p in parts))

    def tried(self) -> Node:
        here = self.start
        self.i += 1
        parts: list = [("body", self.block())]
        while self.val() in ("catch", "finally"):
            at, word, declared = self.start, self.next()[1], None
            if self.val() == "(":
                from_ = self.start
                self.skip("(", ")")
                declared = self.node("catch_declaration", from_)
            if self.take("when"):
                self.skip("(", ")")
            parts.append((None, self.node(f"{word}_clause", at, (None, declared), ("body", self.block()))))
        return self.node("try_statement", here, *parts)

    def jump(self) -> Node:
        here, word = self.start, self.next()[1]
        value = None
        if word == "yield" and self.take("return"):
            value = self.expression()
        while self.i < len(self.toks) and not self.take(";"):
            self.i += 1
        return self.node(f"{word}_statement", here, (None, value))

    def case(self) -> Node:
        here = self.start
        while self.i < len(self.toks) and not self.take(":", "=>"):
            self.i += 1
        return self.node("case_label", here)

    def statement(self) -> Node | None:
        here = self.start
        while self.val() == "[" and self.kind(1) == "name":
            self.skip("[", "]")
        if self.val() in self.MODIFIERS and self.val(1) != "(" and self.val() != "new":
            while self.val() in self.MODIFIERS:
                self.i += 1
        if self.kind() == "name" and self.val() not in self.STATEMENTS and self.val() not in ("await", "throw", "new", "this", "base"):
            if self._typed():
                if self._local():
                    self.type()
                    return self.method(here, "local_function_statement")
                return self.variables(here)
        return super().statement()

    def _local(self) -> bool:
        at = self.i
        try:
            self.type()
            return self.kind() == "name" and self.val(1) == "("
        finally:
            self.i = at

    def generics(self) -> None:
        if self.val() == "<":
            at = self.i
            try:
                self.angle()
                if self.val() != "(":
                    self.i = at
            except Bad:
                self.i = at

    def argument(self) -> Node:
        here = self.start
        if self.kind() == "name" and self.val(1) == ":" and self.val(2) != ":":
            self.i += 2
        if self.val() in ("out", "ref") and self.kind(1) == "name" and self.kind(2) == "name":
            self.i += 1
            self.type()
        return self.node("argument", here, (None, self.expression()))

    def primary(self) -> Node:
        here = self.start
        if self.val() == "(" and self._lambda():
            params = self.parameters()
            return self.arrow(here, params)
        if self.val() == "[":
            return self.arguments("collection_expression", "[", "]")
        if self.val() == "(" and self._cast():
            self.skip("(", ")")
            return self.node("cast_expression", here, (None, self.unary()))
        if self.val() == "(":
            e = self.arguments("parenthesized_expression")
            for k, (f, c) in enumerate(e.children):  # its values are no arguments
                if c.kind == "argument":
                    e.children[k] = (f, c.children[0][1])
            return e
        if self.kind() == "string" and self.toks[self.i][1][:2].find("$") >= 0:
            return self.interpolated()
        return super().primary()

    def _cast(self) -> bool:
        at = self.i
        try:
            self.i += 1
            self.type()
            return self.val() == ")" and (self.kind(1) in ("name", "string", "number") or self.val(1) == "(") and self.val(1) not in ("is", "as")
        except Bad:
            return False
        finally:
            self.i = at

    def interpolated(self) -> Node:
        t = self.next()
        parts = []
        for m in re.finditer(r"(?<!\{)\{(?!\{)([^{}\"]*)\}", t[1]):
            inner = CSharp(m[1].split(":")[0] if "?" not in m[1] else m[1])
            try:
                e = inner.expression()
            except (Bad, RecursionError):
                continue
            for n in e.nodes():
                n.start, n.end = n.start + t[2] + m.start(1), n.end + t[2] + m.start(1)
            parts.append((None, Node("interpolation", t[2] + m.start(), t[2] + m.end(), [(None, e)])))
        return Node("interpolated_string_expression", t[2], t[3], parts)

    def _lambda(self) -> bool:
        level = 0
        for j in range(self.i, len(self.toks)):
            v = self.toks[j][1] if self.toks[j][0] == "mark" else ""
            level += (v == "(") - (v == ")")
            if level == 0:
                return j + 1 < len(self.toks) and self.toks[j + 1][1] == "=>"
        return False

    def arrow(self, here: int, params: Node) -> Node:
        self.need("=>")
        return self.node("lambda_expression", here, ("parameters", params), ("body", self.block() if self.val() == "{" else self.expression()))

    def word(self) -> Node:
        here = self.start
        if self.val(1) == "=>":
            return self.arrow(here, self.node("parameter_list", here, (None, self.node("parameter", here, ("name", self.name())))))
        if self.take("async"):
            return self.primary()
        if self.take("new"):
            kind = self.type() if self.val() not in ("(", "{", "[") else None
            if self.val() == "[":
                self.skip("[", "]")
            args = self.arguments() if self.val() == "(" else None
            filled = self.arguments("initializer_expression", "{", "}") if self.val() == "{" else None
            return self.node("object_creation_expression", here, ("type", kind), ("arguments", args), ("initializer", filled))
        if self.val() in ("typeof", "sizeof", "nameof", "default") and self.val(1) == "(":
            self.i += 1
            self.skip("(", ")")
            return self.node("typeof_expression", here)
        if self.val() == "delegate" and self.val(1) in ("(", "{"):
            self.i += 1
            params = self.parameters() if self.val() == "(" else None
            return self.node("lambda_expression", here, ("parameters", params), ("body", self.block()))
        name = super().word()
        self.generics()
        return name

    def trailer(self, e: Node) -> Node | None:
        if self.val() == "switch" and self.val(1) == "{":
            self.i += 1
            return self.node("switch_expression", e.start, (None, e), (None, self.block()))
        if self.val() == "with" and self.val(1) == "{":
            self.i += 1
            return self.node("with_expression", e.start, (None, e), (None, self.arguments("initializer_expression", "{", "}")))
        return None


class Rust(Brace):
    WORDS = re.compile(rf'{SPACE}|{COMMENT}|(?P<string>b?r(?P<hashes>#*)"(?s:.*?)"(?P=hashes)|b?"(?:\\(?s:.)|[^"\\])*"?|b?\'(?:\\.[^\']*|[^\'\\\n])\')|(?P<space2>\'[a-z_]\w*)|{NAME}|{NUMBER}|{MARK}')
    MEMBER, ARGUMENTS, STRING = ("field_expression", "value", "field"), "arguments", "string_literal"
    WORD_PREFIX = {"return_", "move", "box"}
    RETURN = "return_expression"
    STATEMENTS = {"fn": "function", "let": "bound", "use": "used", "mod": "module", "impl": "module", "trait": "module", "struct": "declared", "enum": "declared", "type": "declared", "const": "constant", "static": "constant", "extern": "declared", "macro_rules": "declared"}
    HELD = {"if": "if_expression", "while": "while_expression", "for": "for_expression", "loop": "loop_expression", "match": "match_expression"}

    def __init__(self, text: str):
        super().__init__(text)
        self.toks = [t for t in self.toks if t[0] != "space2" and t[0] != "hashes"]

    def statement(self) -> Node | None:
        while self.val() == "#" and self.val(1) in ("[", "!"):
            self.i += 1
            self.take("!")
            self.skip("[", "]")
        if self.take("pub"):
            if self.val() == "(":
                self.skip("(", ")")
        while self.val() in ("async", "unsafe", "const", "extern", "default") and (self.val(1) in ("fn", "impl", "trait", "extern", "unsafe", "async") or self.kind(1) == "string"):
            self.i += 1
            if self.kind() == "string":
                self.i += 1
        return super().statement()

    def function(self) -> Node:
        here = self.start
        self.i += 1
        name = self.name()
        if self.val() == "<":
            self.angle_any()
        params = self.parameters("(", ")", "parameters")
        while self.i < len(self.toks) and self.val() not in ("{", ";"):
            self.i += 1
        body = self.block() if self.val() == "{" else None
        self.take(";")
        return self.node("function_item", here, ("name", name), ("parameters", params), ("body", body))

    def angle_any(self) -> None:
        level = 0
        while self.i < len(self.toks):
            v = self.val()
            level += (v == "<") - (v == ">")
            self.i += 1
            if level == 0:
                return

    def parameters(self, opener: str, closer: str, kind: str) -> Node:
        here, out = self.start, []
        self.need(opener)
        while self.i < len(self.toks) and self.val() != closer:
            at, name, level = self.start, None, 0
            while self.i < len(self.toks) and not (level == 0 and self.val() in (",", closer)):
                v = self.val()
                if name is None and self.kind() == "name" and v not in ("mut", "ref"):
                    name = self.name()
                    continue
                level += (v in ("(", "<", "[")) - (v in (")", ">", "]"))
                self.i += 1
            out.append(self.node("parameter", at, ("pattern", name)))
            self.take(",")
        self.need(closer)
        return self.node(kind, here, *((None, p) for p in out))

    def bound(self) -> Node:
        here = self.start
        self.i += 1
        at, level = self.start, 0
        names: list = []
        while self.i < len(self.toks) and not (level == 0 and self.val() in ("=", ";", ":")):
            if self.kind() == "name" and self.val() not in ("mut", "ref") and self.val(1) not in ("(", "::", "{"):
                names.append(self.name())
            else:
                level += (self.val() in ("(", "{", "[")) - (self.val() in (")", "}", "]"))
                self.i += 1
        pattern = names[0] if len(names) == 1 else self.node("tuple_pattern", at, *((None, n) for n in names))
        if self.take(":"):
            while self.i < len(self.toks) and self.val() not in ("=", ";"):
                self.i += 1
        value = self.expression() if self.take("=") else None
        other = self.block() if self.take("else") else None
        self.take(";")
        return self.node("let_declaration", here, ("pattern", pattern), ("value", value), ("alternative", other))

    def constant(self) -> Node:
        here, word = self.start, self.next()[1]
        self.take("mut")
        name = self.name()
        while self.i < len(self.toks) and self.val() not in ("=", ";"):
            self.i += 1
        value = self.expression() if self.take("=") else None
        self.take(";")
        return self.node(f"{word}_item", here, ("name", name), ("value", value))

    def used(self) -> Node:
        here = self.start
        self.i += 1
        tree = self.imported()
        self.take(";")
        return self.node("use_declaration", here, ("argument", tree))

    def imported(self) -> Node:
        here = self.start
        self.take("::")
        if self.val() == "{":
            self.i += 1
            parts = []
            while self.i < len(self.toks) and self.val() != "}":
                if not self.take(","):
                    parts.append((None, self.imported()))
            self.need("}")
            return self.node("use_list", here, *parts)
        if self.take("*"):
            return self.node("use_wildcard", here)
        path = self.name()
        while self.take("::"):
            if self.val() in ("{", "*"):
                inner = self.imported()
                return self.node("scoped_use_list" if inner.kind == "use_list" else "use_wildcard", here, ("path", path), ("list", inner))
            path = self.node("scoped_identifier", here, ("path", path), ("name", self.name()))
        if self.take("as"):
            return self.node("use_as_clause", here, ("path", path), ("alias", self.name()))
        return path

    def module(self) -> Node:
        here, word = self.start, self.next()[1]
        while self.i < len(self.toks) and self.val() not in ("{", ";"):
            self.i += 1
        body = self.block("declaration_list") if self.val() == "{" else None
        self.take(";")
        return self.node(f"{word}_item", here, ("body", body))

    def declared(self) -> Node:
        here = self.start
        self.i += 1
        while self.i < len(self.toks) and self.val() not in ("{", ";", "("):
            self.i += 1
        if self.val() in ("{", "("):
            self.skip(self.val(), {"{": "}", "(": ")"}[self.val()])
        self.take(";")
        return self.node("item", here)

    def word(self) -> Node:
        here, v = self.start, self.val()
        if v in self.HELD:
            return self.held()
        if v == "unsafe" and self.val(1) == "{":
            self.i += 1
            return self.node("unsafe_block", here, (None, self.block()))
        if v in ("async", "loop") and self.val(1) in ("{", "move"):
            self.i += 1
            self.take("move")
            return self.block()
        if v in ("return", "break", "continue"):
            self.i += 1
            value = None if self.val() in (";", "}", ",", ")") or self.kind() == "end" else self.expression()
            return self.node(f"{v}_expression", here, (None, value))
        if v in ("true", "false"):
            return self.leaf("boolean_literal")
        path = self.name()
        while self.val() == "::" or self.val() == "!" and self.val(1) in ("(", "[", "{") and self.val(2) != "=":
            if self.take("!"):
                closer = {"(": ")", "[": "]", "{": "}"}[self.val()]
                try:
                    at = self.i
                    inner = self.arguments("token_tree", self.val(), closer)
                except Bad:
                    self.i, from_ = at, self.start
                    self.skip(self.val(), closer)
                    inner = self.node("token_tree", from_)
                return self.node("macro_invocation", here, ("macro", path), (None, inner))
            self.i += 1
            if self.val() == "<":
                self.angle_any()
                continue
            path = self.node("scoped_identifier", here, ("path", path), ("name", self.name()))
        return path

    def held(self) -> Node:
        here, kind, parts = self.start, self.HELD[self.next()[1]], []
        if kind == "for_expression":
            pattern = []
            while self.i < len(self.toks) and self.val() != "in":
                pattern.append((None, self.name())) if self.kind() == "name" else self.next()
            self.take("in")
            parts += [("pattern", self.node("tuple_pattern", here, *pattern)), ("value", self.headed_expression())]
        elif kind != "loop_expression":
            parts.append(("condition", self.condition()))
        parts.append(("body", self.arms() if kind == "match_expression" else self.block()))
        if self.take("else"):
            parts.append(("alternative", self.held() if self.val() == "if" else self.block()))
        return self.node(kind, here, *parts)

    def headed_expression(self) -> Node:
        headed, self.headed = self.headed, True
        e = self.expression()
        self.headed = headed
        return e

    def condition(self) -> Node:
        here = self.start
        if not self.take("let"):
            return self.headed_expression()
        names = []
        while self.i < len(self.toks) and self.val() != "=":
            names.append((None, self.name())) if self.kind() == "name" and self.val(1) not in ("(", "::") else self.next()
        self.need("=")
        pattern = names[0][1] if len(names) == 1 else Node("tuple_pattern", here, self.last, names)
        return self.node("let_condition", here, ("pattern", pattern), ("value", self.headed_expression()))

    def arms(self) -> Node:
        here, headed, self.headed = self.start, self.headed, False
        self.need("{")

        def arm() -> Node | None:
            if self.take(",", ";"):
                return None
            at, level, names = self.start, 0, []
            while self.i < len(self.toks) and not (level == 0 and self.val() == "=>"):
                level += (self.val() in ("(", "{", "[")) - (self.val() in (")", "}", "]"))
                if level < 0:
                    raise Bad
                self.i += 1
            self.need("=>")
            return self.node("match_arm", at, *names, ("value", self.expression()))

        parts = self.many(arm, "}")
        self.take("}")
        self.headed = headed
        return self.node("match_block", here, *((None, p) for p in parts))

    def primary(self) -> Node:
        here = self.start
        if self.val() in ("|", "||"):
            params = self.parameters("|", "|", "closure_parameters") if self.val() == "|" else None
            if params is None:
                self.i += 1
            if self.take("->"):
                self.type()
            return self.node("closure_expression", here, ("parameters", params), ("body", self.expression()))
        if self.val() == "{":
            return self.block()
        if self.val() == "[":
            return self.arguments("array_expression", "[", "]")
        if self.val() in ("<",):
            self.angle_any()
            self.take("::")
            return self.word()
        return super().primary()

    def generics(self) -> None:
        if self.val() == "::" and self.val(1) == "<":
            self.i += 1
            self.angle_any()

    def trailer(self, e: Node) -> Node | None:
        if self.val() == "{" and not self.headed and e.kind in ("identifier", "scoped_identifier") and re.search(r"(^|::)[A-Z]\w*$", self.text[e.start : e.end]):
            here, parts = self.start, []
            self.i += 1
            while self.i < len(self.toks) and self.val() != "}":
                if self.take(",", ".."):
                    continue
                at = self.start
                value = self.expression()
                if self.take(":"):
                    value = self.node("field_initializer", at, ("field", value), ("value", self.expression()))
                parts.append((None, value))
            self.need("}")
            return self.node("struct_expression", e.start, ("name", e), ("body", self.node("field_initializer_list", here, *parts)))
        return None


def parser(kind: type[Brace]):
    return lambda text: deeply(lambda t: kind(t).program(), text)


go, csharp, rust = parser(Go), parser(CSharp), parser(Rust)

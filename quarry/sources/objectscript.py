"""A tolerant parser for ObjectScript classes and routines. Node kinds are those that rules name."""

from __future__ import annotations

import re

from .tree import Bad, Node, Stream, deeply

WORDS = re.compile(
    r"(?P<space>[ \t\r\n]+)|(?P<comment>//[^\n]*|##;[^\n]*|#;[^\n]*|/\*(?s:.*?)(?:\*/|\Z)|;[^\n]*)|(?P<string>\"(?:\"\"|[^\"\n])*\"?)|(?P<special>&(?:sql|html|js|javascript)(?=[(<])|##class(?=\()|##super(?=\()|\$\$\$\w+|\$\$%?\w+(?:\^%?[\w.]+)?|\$\$\^%?[\w.]+|\$[A-Za-z]\w*(?:\.[A-Za-z]\w*)*)"
    r"|(?P<name>%?[^\W\d_][^\W_]*|%(?=\W))|(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|\.\d+)|(?P<mark>'=|'<|'>|'\[|'\]|'&|'!|'\?|<=|>=|&&|\|\||\]\]|\*\*|\.\.\.|\.\.|[{}()\[\],:.+\-*/\\#_=<>&!?'@^$%|~])",
    re.I,
)
#: Commands with their short forms: fixed names of the language.
COMMANDS = {"set": "set", "s": "set", "do": "do", "d": "do", "write": "write", "w": "write", "quit": "quit", "q": "quit", "return": "return", "ret": "return", "read": "read", "r": "read", "if": "if", "i": "if", "elseif": "elseif", "else": "else", "e": "else", "for": "for", "f": "for", "while": "while", "kill": "kill", "k": "kill", "new": "new", "n": "new", "xecute": "xecute", "x": "xecute", "open": "open", "o": "open", "use": "use", "u": "use", "close": "close", "c": "close", "goto": "goto", "g": "goto", "break": "break", "b": "break", "zwrite": "zwrite", "zw": "zwrite", "ztrap": "ztrap", "zt": "ztrap", "halt": "halt", "h": "hang", "hang": "hang", "job": "job", "j": "job", "lock": "lock", "l": "lock", "merge": "merge", "m": "merge", "throw": "throw", "try": "try", "catch": "catch", "tstart": "tstart", "tcommit": "tcommit", "trollback": "trollback", "continue": "continue", "zn": "znspace", "znspace": "znspace", "view": "view"}
BARE = {"quit", "return", "break", "for", "else", "do", "kill", "new", "zwrite", "write", "continue", "halt", "try", "throw"}
OPERATORS = {"+", "-", "*", "/", "\\", "#", "**", "_", "=", "'=", "<", "'<", ">", "'>", "<=", ">=", "&", "&&", "!", "||", "[", "'[", "]", "']", "]]", "'&", "'!", "?", "'?"}
MEMBERS = {"method", "classmethod", "clientmethod", "query", "trigger"}


class ObjectScript(Stream):
    def __init__(self, text: str):
        super().__init__(text, WORDS)

    def val(self, k: int = 0) -> str:
        return super().val(k).lower()

    def program(self) -> Node:
        classy = re.search(r"^\s*(?:///[^\n]*\n|\s)*(?:Import[^\n]*\n|Include[^\n]*\n|\s|///[^\n]*\n)*Class\s", self.text, re.I) is not None
        self.placed_in = None
        root = Node("source_file", 0, len(self.text), [(None, s) for s in (self.many(self.member, "") if classy else self.many(self.routine, ""))])
        return self.placed(root)

    # -- classes -----------------------------------------------------------------------------------------------------
    def member(self) -> Node | None:
        here, v = self.start, self.val()
        if v in ("class", "import", "include"):
            name = None
            self.i += 1
            if v == "class":
                at = self.start
                while self.kind() == "name" or self.val() == ".":
                    self.i += 1
                    if self.kind() == "name" and self.val(-1) != ".":
                        break
                name = self.node("class_name", at)
            while self.i < len(self.toks) and self.val() != "{" and not (v != "class" and self.fresh):
                self.i += 1
            self.take("{")
            return self.node("class_definition" if v == "class" else f"{v}_code", here, (None, name))
        if v in MEMBERS:
            return self.method()
        if v in ("property", "parameter", "index", "relationship", "projection", "foreignkey", "storage", "xdata"):
            self.i += 1
            while self.i < len(self.toks) and self.val() not in ("{",) and not (self.fresh and (self.val() in MEMBERS or self.val() in ("property", "parameter", "index", "relationship", "projection", "storage", "xdata", "}"))):
                self.i += 1
            if self.val() == "{":
                self.skip("{", "}")
            return self.node(f"{v}_definition", here)
        self.i += 1
        return None

    def method(self) -> Node:
        here = self.start
        self.i += 1
        name = self.leaf("method_name") if self.kind() in ("name", "string") else None
        args = self.formal() if self.val() == "(" else None
        while self.i < len(self.toks) and self.val() != "{":
            if self.val() == "[":
                self.skip("[", "]")
            else:
                self.i += 1
        body = self.braces("method_body") if self.val() == "{" else None
        return self.node("method_definition", here, (None, name), (None, args), (None, body))

    def formal(self) -> Node:
        here, parts = self.start, []
        self.need("(")
        while self.i < len(self.toks) and self.val() != ")":
            at = self.start
            while self.val() in ("byref", "output", "byval", "&", "*") and self.val(1) not in (",", ")", "=", "as"):
                self.i += 1
            if self.kind() != "name":
                raise Bad
            name = self.leaf("lvn")
            arg = Node("method_arg", name.start, name.end, [(None, Node("expression", name.start, name.end, [(None, name)]))])
            level = 0
            while self.i < len(self.toks) and not (level == 0 and self.val() in (",", ")")):
                level += (self.val() in ("(", "{", "[")) - (self.val() in (")", "}", "]"))
                self.i += 1
            parts.append((None, self.node("argument", at, (None, arg))))
            self.take(",")
        self.need(")")
        return self.node("arguments", here, *parts)

    # -- routines: labels at the start of a line ------------------------------------------------------------------------
    def routine(self) -> Node | None:
        here = self.start
        at_line_start = here == 0 or self.text[here - 1] == "\n"
        if self.val() == "routine" and self.kind(1) == "name":
            while self.i < len(self.toks) and not (self.fresh and self.start > here):
                self.i += 1
            return self.node("routine_header", here)
        if at_line_start and self.kind() == "name":
            name = self.leaf("method_name")
            args = self.formal() if self.val() == "(" and self.text[self.last : self.start] == "" else None
            while self.val() in ("public", "private", "[") or self.val() == "]":
                self.i += 1
            if self.val() == "{":
                return self.node("method_definition", here, (None, name), (None, args), (None, self.braces("method_body")))
            start, body = self.start, []
            while self.i < len(self.toks) and not (self.kind() == "name" and (self.start == 0 or self.text[self.start - 1] == "\n")):
                at = self.i
                body += self.many_one(self.command)
                if self.i == at:
                    self.i += 1
            return self.node("method_definition", here, (None, name), (None, args), (None, self.node("method_body", start, *((None, s) for s in body))))
        return self.command()

    def many_one(self, one) -> list[Node]:
        at, here = self.i, self.start
        try:
            found = one()
        except (Bad, RecursionError):
            self.i = max(self.i, at + 1)
            while self.i < len(self.toks) and not self.fresh and self.val() != "}":
                self.i += 1
            found = Node("ERROR", here, self.last)
        return [found] if found is not None else []

    # -- commands ----------------------------------------------------------------------------------------------------
    def braces(self, kind: str) -> Node:
        here = self.start
        self.need("{")
        body = []
        while self.i < len(self.toks) and self.val() != "}":
            at = self.i
            body += self.many_one(self.command)
            if self.i == at:
                self.i += 1
        self.take("}")
        return self.node(kind, here, *((None, s) for s in body))

    def command(self) -> Node | None:
        here, v = self.start, self.val()
        if v == "}":
            return None
        if self.kind() == "special" and self.toks[self.i][1].lower().startswith("&"):
            self.i += 1
            self.skip("(", ")") if self.val() == "(" else self.skip("<", ">")
            return self.node("embedded_code", here)
        if self.kind() == "special" and self.toks[self.i][1].startswith("$$$"):
            macro = self.expression()
            return self.node("macro_statement", here, (None, macro))
        if v == "#":
            while self.i < len(self.toks):
                self.i += 1
                if self.fresh:
                    break
            return self.node("preprocessor", here)
        if v == "." or self.kind() != "name":
            self.i += 1
            return None
        word = COMMANDS.get(v)
        if word is None:
            raise Bad
        self.i += 1
        if word == "ztrap" or v == "zt":
            word = "ztrap"
        condition = None
        if self.val() == ":" and word not in ("catch", "try"):
            self.i += 1
            condition = ("condition", self.expression())
        gap = self.text[self.last : self.start]
        bare = self.kind() == "end" or "\n" in gap or self.val() in ("}",) or (len(gap) > 1 and word in BARE and self.val() != "{") or (word in BARE and self.val() == "{") or word in ("try", "catch", "else") or v in ("h",) and len(gap) > 1
        parts: list = [condition] if condition else []
        if word == "catch":
            name = None
            if self.take("("):
                name = self.leaf("lvn") if self.kind() == "name" else None
                self.take(")")
            elif self.kind() == "name":
                name = self.leaf("lvn")
            return self.node("catch_block", here, (None, name), (None, self.braces("block")))
        if word in ("try", "else") and self.val() == "{":
            return self.node(f"{word}_block", here, (None, self.braces("block")))
        if not bare:
            read = getattr(self, f"a_{word}", self.a_other)
            parts.append((None, read()))
            while self.take(","):
                parts.append((None, read()))
        if self.val() == "{" and word in ("if", "elseif", "for", "while", "do"):
            parts.append((None, self.braces("block")))
            if word == "do" and self.val() == "while":
                self.i += 1
                parts.append((None, self.expression()))
        return self.node(f"command_{word}", here, *parts)

    def a_set(self) -> Node:
        here = self.start
        if self.val() == "(":
            at, parts = self.start, []
            self.i += 1
            while self.i < len(self.toks) and self.val() != ")":
                parts.append((None, self.target()))
                self.take(",")
            self.need(")")
            target = self.node("set_target_list", at, *parts)
        else:
            target = self.target()
        self.need("=")
        return self.node("set_argument", here, (None, target), (None, self.expression()))

    def target(self) -> Node:
        here = self.start
        return self.node("set_target", here, (None, self.operand()))

    def a_read(self) -> Node:
        here = self.start
        if self.kind() == "string" or self.val() in ("!", "#", "?"):
            while self.i < len(self.toks) and (self.kind() == "string" or self.val() in ("!", "#", "?")):
                self.i += 1
            return self.node("read_argument", here)
        self.take("*")
        at = self.start
        name = self.node("read_variable", at, (None, self.operand()))
        if self.take(":"):
            self.expression()
        return self.node("read_argument", here, (None, name))

    def a_write(self) -> Node:
        here = self.start
        while self.val() in ("!", "#", "?", "*") and (self.val() != "?" or True):
            self.i += 1
        if self.val() in (",", "}") or self.fresh or self.kind() == "end":
            return self.node("write_argument", here)
        return self.node("write_argument", here, (None, self.expression()))

    def a_xecute(self) -> Node:
        here = self.start
        return self.node("xecute_argument", here, (None, self.expression()))

    def _device(self, kind: str) -> Node:
        here = self.start
        device = self.node("device", here, (None, self.expression()))
        while self.take(":"):
            if self.val() not in (":", ","):
                self.expression()
        return self.node(kind, here, (None, device))

    def a_open(self) -> Node:
        return self._device("open_argument")

    def a_use(self) -> Node:
        return self._device("use_argument")

    def a_for(self) -> Node:
        here = self.start
        target = self.target()
        self.need("=")
        parts = [(None, self.expression())]
        while self.take(":"):
            parts.append((None, self.expression()))
        return self.node("for_argument", here, (None, target), *parts)

    def a_goto(self) -> Node:
        here = self.start
        while self.i < len(self.toks) and not self.fresh and self.val() not in (",", "}") and (self.start == here or self.text[self.last : self.start] == ""):
            self.i += 1
        return self.node("goto_argument", here)

    def a_other(self) -> Node:
        e = self.expression()
        while self.take(":"):
            self.expression()
        return e

    # -- expressions -------------------------------------------------------------------------------------------------
    def expression(self) -> Node:
        here, parts = self.start, []
        while True:
            while self.val() in ("+", "-", "'"):
                self.i += 1
            parts.append((None, self.operand()))
            v = self.val()
            if v not in OPERATORS or self.fresh and v not in ("_", "&&", "||", "+"):
                break
            self.i += 1
            if v in ("?", "'?"):
                while self.i < len(self.toks) and (self.kind() in ("number", "name", "string") or self.val() in (".", "(", ")", ",")) and self.text[self.last : self.start] == "":
                    self.i += 1
                break
        return self.node("expression", here, *parts)

    def arguments(self) -> Node:
        here, parts = self.start, []
        self.need("(")
        while self.i < len(self.toks) and self.val() != ")":
            at = self.start
            if self.take(","):
                if self.val() in (",", ")"):
                    parts.append((None, self.node("method_arg", at)))
                continue
            if self.val() == "." and self.kind(1) == "name":
                self.i += 1
            e = self.expression()
            while self.take(":"):
                self.expression()
            parts.append((None, self.node("method_arg", at, (None, e))))
        self.need(")")
        return self.node("method_args", here, *parts)

    def operand(self) -> Node:
        here, k, v = self.start, self.kind(), self.val()
        if k == "string":
            return self.leaf("string_literal")
        if k == "number":
            return self.leaf("numeric_literal")
        if v == "(":
            self.i += 1
            e = self.expression()
            self.need(")")
            return self.chain(self.node("parenthetical_expression", here, (None, e)), here)
        if v == "@":
            self.i += 1
            inner = self.operand()
            if self.take("@"):
                self.skip("(", ")")
            return self.node("indirection", here, (None, inner))
        if v == "..":
            self.i += 1
            if self.take("#"):
                self.next()
                return self.node("class_parameter_ref", here)
            at, name = self.start, self.leaf("method_name" if self.val(1) == "(" else "property_name")
            if self.val() == "(":
                call = self.node("oref_method", at, (None, name), (None, self.arguments()))
                return self.chain(self.node("relative_dot_method", here, (None, call)), here)
            return self.chain(self.node("relative_dot_property", here, (None, self.node("oref_property", at, (None, name)))), here)
        if k == "special":
            return self.special()
        if v == "^":
            self.i += 1
            name = self.leaf("identifier") if self.kind() == "name" else None
            while self.val() == "." and self.kind(1) == "name" and self.text[self.last : self.start] == "":
                self.i += 2
            subs = self.arguments() if self.val() == "(" else None
            return self.node("gvn", here, (None, name), (None, subs))
        if v in ("{", "["):
            closer = {"{": "}", "[": "]"}[v]
            self.i += 1
            parts = []
            while self.i < len(self.toks) and self.val() != closer:
                if not self.take(",", ":"):
                    parts.append((None, self.expression()))
            self.need(closer)
            return self.chain(self.node("json_literal", here, *parts), here)
        if v == "." and self.kind(1) == "name":
            self.i += 1
            return self.leaf("lvn")
        if k == "name":
            if v in ("i", "r", "m") and self.val(1) == "%" and self.text[self.toks[self.i][3]] == "%":
                self.i += 2
                self.next()
                return self.node("instance_variable", here)
            name = self.leaf("lvn")
            if self.val() == "(" and self.text[self.last : self.start] == "":
                subs = self.arguments()
                name = self.node("lvn", here, (None, subs))
            return self.chain(name, here)
        raise Bad

    def special(self) -> Node:
        here, t = self.start, self.toks[self.i]
        low = t[1].lower()
        self.i += 1
        if low == "##class":
            at = self.start
            self.need("(")
            name_at = self.start
            while self.i < len(self.toks) and self.val() != ")":
                self.i += 1
            ref = self.node("class_name", name_at)
            self.need(")")
            ref = self.node("class_ref", at, (None, ref))
            if self.take("."):
                if self.take("#"):
                    self.next()
                    return self.node("class_parameter_ref", here, (None, ref))
                name = self.leaf("method_name")
                args = self.arguments() if self.val() == "(" else None
                return self.chain(self.node("class_method_call", here, (None, ref), (None, name), (None, args)), here)
            return self.node("class_instance", here, (None, ref), (None, self.operand() if self.kind() == "name" else None))
        if low == "##super":
            return self.node("superclass_method_call", here, (None, self.arguments()))
        if low.startswith("$$$"):
            return self.chain(self.node("macro", here, (None, self.arguments() if self.val() == "(" and self.text[self.last : self.start] == "" else None)), here)
        if low.startswith("$$"):
            return self.node("routine_tag_call", here, (None, self.arguments() if self.val() == "(" else None))
        dot = t[1].rfind(".")
        name = Node("method_name", t[2] + dot + 1, t[3]) if dot > 0 else None
        args = self.arguments() if self.val() == "(" and self.text[self.last : self.start] == "" else None
        return self.chain(self.node("system_defined_function", here, (None, name), *([(None, a) for _, a in args.children] if args and dot < 0 else [(None, args)])), here)

    def chain(self, e: Node, here: int) -> Node:
        segments = []
        while self.val() == "." and self.kind(1) == "name" and self.text[self.last : self.start] == "":
            at = self.toks[self.i][2]
            self.i += 1
            start, name = self.start, self.leaf("method_name" if self.val(1) == "(" else "property_name")
            if self.val() == "(" and self.text[self.last : self.start] == "":
                inner = self.node("oref_method", start, (None, Node("method_name", name.start, name.end)), (None, self.arguments()))
            else:
                inner = Node("oref_property", start, name.end, [(None, Node("property_name", name.start, name.end))])
            segments.append((None, self.node("oref_chain_segment", at, (None, inner))))
        return self.node("oref_chain_expr", here, (None, e), *segments) if segments else e


def objectscript(text: str) -> Node:
    return deeply(lambda t: ObjectScript(t).program(), text)

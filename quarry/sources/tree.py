"""Syntax trees of all front-ends: nodes, tolerant token streams, and rows of an interval-encoded tree."""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from collections.abc import Callable, Iterator

#: Calls that may be nested in a parser: a bound of the interpreter, whose frames lie on the heap.
FRAMES = 2_000_000


class Node:
    __slots__ = ("kind", "start", "end", "children")

    def __init__(self, kind: str, start: int, end: int, children: list | None = None):
        self.kind, self.start, self.end, self.children = kind, start, end, children or []

    def get(self, field: str) -> Node | None:
        return next((c for f, c in self.children if f == field), None)

    def nodes(self) -> Iterator[Node]:
        """This node and all below, in order of their start."""
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo.extend(c for _, c in reversed(n.children))


class Bad(Exception):
    """What follows isn't what a parser expects; it goes on at the next statement."""


class Stream:
    """A token stream: (kind, text, start, end, whether a line ends before it). Kinds: name, mark, number, string, other."""

    def __init__(self, text: str, words: re.Pattern):
        self.text, self.i, self.toks, self.comments = text, 0, [], []
        at, line = 0, False
        while at < len(text):
            m = words.match(text, at)
            kind, end = (m.lastgroup, m.end()) if m and m.end() > at else ("other", at + 1)
            if kind == "space":
                line |= "\n" in text[at:end]
            elif kind == "comment":
                line |= "\n" in text[at:end]
                self.comments.append(Node("comment", at, end))
            else:
                self.toks.append((kind, text[at:end], at, end, line))
                line = False
            at = end

    def val(self, k: int = 0) -> str:
        """The next name or mark; "" for literals and at the end."""
        j = self.i + k
        return self.toks[j][1] if 0 <= j < len(self.toks) and self.toks[j][0] in ("name", "mark") else ""

    def kind(self, k: int = 0) -> str:
        j = self.i + k
        return self.toks[j][0] if 0 <= j < len(self.toks) else "end"

    @property
    def start(self) -> int:
        return self.toks[self.i][2] if self.i < len(self.toks) else len(self.text)

    @property
    def last(self) -> int:
        return self.toks[self.i - 1][3] if self.i else 0

    @property
    def fresh(self) -> bool:
        """Whether the next token starts a line, or there is none."""
        return self.i >= len(self.toks) or self.toks[self.i][4]

    def next(self) -> tuple:
        if self.i >= len(self.toks):
            raise Bad
        self.i += 1
        return self.toks[self.i - 1]

    def take(self, *values: str) -> bool:
        if self.val() and self.val() in values:
            self.i += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise Bad

    def node(self, kind: str, start: int, *children: tuple) -> Node:
        return Node(kind, start, self.last, [(f, c) for f, c in children if c is not None])

    def leaf(self, kind: str) -> Node:
        t = self.next()
        return Node(kind, t[2], t[3])

    def name(self, kind: str = "identifier") -> Node:
        if self.kind() != "name":
            raise Bad
        return self.leaf(kind)

    def skip(self, opener: str, closer: str) -> None:
        """Past the closer of the opener that comes next."""
        level = 0
        while self.i < len(self.toks):
            v = self.val()
            self.i += 1
            level += (v == opener) - (v == closer)
            if level == 0:
                return

    def many(self, one: Callable[[], Node | None], closer: str, stops: tuple = (";", "}")) -> list[Node]:
        """Statements up to a closer (not taken). One that can't be read becomes an ERROR node, up to where a statement may start."""
        out = []
        while self.i < len(self.toks) and not (closer and self.val() == closer):
            at, here = self.i, self.start
            try:
                found = one()
            except (Bad, RecursionError):
                self.i, level = max(self.i, at + 1), 0
                while self.i < len(self.toks) and not (level <= 0 and (self.val() in stops or self.fresh)):
                    level += (self.val() in ("{", "(", "[")) - (self.val() in ("}", ")", "]"))
                    self.i += 1
                if self.val() == ";" or (self.val() in stops and self.val() != closer):
                    self.i += 1
                found = Node("ERROR", here, self.last)
            if found is not None:
                out.append(found)
            if self.i == at:
                self.i += 1
        return out

    def placed(self, root: Node) -> Node:
        """The tree with its comments, each in the innermost node around it."""
        for c in self.comments:
            node = root
            while True:
                inner = next((x for _, x in node.children if x.start <= c.start and c.end <= x.end and x.kind != "comment"), None)
                if inner is None:
                    break
                node = inner
            node.children.insert(sum(1 for _, x in node.children if x.start < c.start), (None, c))
        return root


def deeply(parse: Callable[[str], Node], text: str) -> Node:
    """parse(text) with room for deep nesting."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, FRAMES))
    try:
        return parse(text)
    finally:
        sys.setrecursionlimit(before)


class Places:
    """Bytes of UTF-8, lines and columns (from 1, columns in bytes) of character offsets."""

    def __init__(self, text: str):
        raw = text.encode("utf-8", "surrogatepass")
        self.bytes = None
        if len(raw) != len(text):
            self.bytes = [0]
            for c in text:
                self.bytes.append(self.bytes[-1] + len(c.encode("utf-8", "surrogatepass")))
        self.lines = [0] + [m.end() for m in re.finditer(b"\n", raw)]

    def spot(self, at: int) -> tuple[int, int, int]:
        b = at if self.bytes is None else self.bytes[at]
        line = bisect_right(self.lines, b)
        return b, line, b - self.lines[line - 1] + 1


def rows(path: str, text: str, parse: Callable[[str], Node]) -> Iterator[dict]:
    """The tree's rows in preorder. Offsets are bytes of UTF-8; lines and columns count from 1, columns in bytes."""
    places, out, post = Places(text), [], 0
    root = parse(text)
    todo = [(root, None, None, 0, 1, 0, False)]
    while todo:
        node, parent, field, sibling, siblings, depth, closing = todo.pop()
        if closing:
            out[sibling]["post"] = post
            post += 1
            continue
        i, (sb, sl, sc), (eb, el, ec) = len(out), places.spot(node.start), places.spot(node.end)
        out.append({"path": path, "id": i, "parent_id": parent, "field": field, "kind": node.kind, "sibling_ix": sibling, "siblings": siblings, "pre": i, "depth": depth, "start_byte": sb, "end_byte": eb, "start_line": sl, "start_col": sc, "end_line": el, "end_col": ec, "text": text[node.start : node.end] if node is not root else ""})
        todo.append((node, None, None, i, 0, 0, True))
        for k in range(len(node.children) - 1, -1, -1):
            f, c = node.children[k]
            todo.append((c, i, f, k, len(node.children), depth + 1, False))
    return iter(out)

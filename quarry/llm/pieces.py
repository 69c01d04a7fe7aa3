"""A SentencePiece BPE vocabulary as a path problem.

A token sequence is the BPE encoding of a text exactly when each of its adjacent token pairs is the encoding of the pair's own
text: merges inside a pair happen in the same order alone or inside a longer text, so a merge that crosses a border in the
long text would cross it in the pair as well. Encoding is thus a walk over tokens with local conditions, which chunks of a
text can be solved for independently and which proves a splice at any token that two overlapping encodings share.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

SPACE = "▁"
ATOM = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def default_model() -> bytes:
    import public_tokenizers

    return model_bytes(public_tokenizers.path("piece_bpe_32k.model"))


@lru_cache(maxsize=2)
def vocabulary(proto: bytes) -> Vocabulary:
    """The encoder for a model, kept by each Python worker."""
    return Vocabulary(proto)


class Vocabulary:
    """Encoder for one model."""

    def __init__(self, proto: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(proto)
        spec = model.normalizer_spec
        self.full = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.plain_normalizer = spec.name == "identity" and not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and spec.escape_whitespaces
        self.prefix = spec.add_dummy_prefix
        spec.add_dummy_prefix = False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.score = {p.piece: p.score for p in model.pieces if p.type in (1, 4, 5)}
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (1, 4, 5)}
        self.longest = max(map(len, self.score), default=1)
        self.length = np.array([len(p.piece) if p.type in (1, 4, 5) else 1 for p in model.pieces], np.int64)
        self.byte = np.full(len(model.pieces), -1, np.int64)
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.byte[i] = int(p.piece[3:-1], 16)
        inner = "".join(p for p in self.score if len(p) > 1)
        #: Words can be encoded one by one if no piece runs over the start of a space or over a line's end.
        self.by_word = "\n" not in inner and not any(SPACE in p.lstrip(SPACE) for p in self.score) and model.trainer_spec.model_type == 2
        self.stable = lru_cache(maxsize=200_000)(self._stable)
        self.alone = lru_cache(maxsize=200_000)(lambda t: len(t) == 1 or self.merged(t) == (t,))

    def normalize(self, text: str) -> str:
        if not text:
            return ""
        if self.plain_normalizer:
            text = text.replace(" ", SPACE)
            return SPACE + text if self.prefix else text
        return self.full.normalize(text)

    # -- whole texts by the library ----------------------------------------------------------------------------------
    def encode_many(self, texts: list[str]) -> list[list[int]]:
        return self.full.encode(texts, num_threads=1) if texts else []

    def encode(self, text: str) -> list[int]:
        return self.full.encode(text)

    def encode_normal(self, normal: str) -> list[int]:
        """Ids of a normalised text."""
        return self.bare.encode(normal) if normal else []

    def count_many(self, texts: list[str], window: int = 32_768, overlap: int = 64) -> list[int]:
        counts = iter([len(x) for x in self.encode_many([t for t in texts if len(t) < window])])
        return [next(counts) if len(t) < window else self.count(t, window, overlap) for t in texts]

    def lengths(self, ids: np.ndarray) -> np.ndarray:
        """Characters of each token; of a character spelt as bytes only the last byte has one."""
        out = self.length[ids]
        byte = self.byte[ids]
        if (byte >= 0).any():
            follows = np.append((byte[1:] & 0xC0) == 0x80, False) & (np.append(byte[1:], -1) >= 0)
            out = np.where((byte >= 0) & follows, 0, out)
        return out

    # -- token counts of long texts: overlapping windows ---------------------------------------------------------------
    def count(self, text: str, window: int = 32_768, overlap: int = 64) -> int:
        """Tokens of a whole text. Longer texts are encoded in overlapping windows, spliced at the first token that both
        windows give the same place: both encodings are valid up to and from it, so the splice is the encoding. Where an
        overlap has no such token it is doubled, up to the rest of the text."""
        normal = self.normalize(text)
        if len(normal) <= window:
            return len(self.encode_normal(normal))
        begin, ids, starts, lens = 0, *self._placed(normal, 0, window)
        total, first = 0, 0
        while True:
            end = begin + int(starts[-1] + lens[-1]) if len(ids) else begin
            if end >= len(normal):
                return total + len(ids) - first
            wide = overlap
            while True:
                at = max(begin, end - wide)
                if at <= begin:  # the overlap is the whole window: take it again, longer
                    ids, starts, lens = self._placed(normal, begin, end + wide + window)
                    break
                ids2, starts2, lens2 = self._placed(normal, at, end + window)
                tail = starts + begin >= at
                tail[:first] = False
                mine = (starts[tail] + begin) * 64 + np.minimum(lens[tail], 63)
                mine = mine[(lens[tail] > 0) & (self.byte[ids[tail]] < 0)]
                head = starts2 + at < end
                theirs = (starts2[head] + at) * 64 + np.minimum(lens2[head], 63)
                ok = (lens2[head] > 0) & (self.byte[ids2[head]] < 0)
                both = np.intersect1d(mine, theirs[ok])
                if len(both):
                    spot = int(both[0])
                    here = int(np.searchsorted(starts + begin, spot // 64, side="right")) - 1
                    total += here - first  # the shared token counts with the next window
                    first = int(np.searchsorted(starts2 + at, spot // 64, side="right")) - 1
                    begin, ids, starts, lens = at, ids2, starts2, lens2
                    break
                wide *= 2

    def _placed(self, normal: str, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = np.array(self.encode_normal(normal[a:b]), np.int64)
        lens = self.lengths(ids)
        return ids, np.cumsum(lens) - lens, lens

    # -- walks over tokens -----------------------------------------------------------------------------------------------
    def merged(self, text: str) -> tuple[str, ...]:
        """BPE of a short text by its definition: merge the best-scored adjacent pair, the leftmost of equals, until none is left."""
        parts = list(text)
        while len(parts) > 1:
            best, where = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, where = s, i
            if best is None:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return tuple(parts)

    def _stable(self, a: str, b: str) -> bool:
        return self.merged(a + b) == (a, b)

    def tokens_at(self, text: str, at: int) -> list[int]:
        """Ends of the tokens that may start at a place."""
        ends = [at + 1] if at < len(text) else []
        for e in range(at + 2, min(at + self.longest, len(text)) + 1):
            if text[at:e] in self.score and self.alone(text[at:e]):
                ends.append(e)
        return ends

    def spell(self, token: str) -> list[int]:
        """Ids of one token: its own, or those of its bytes."""
        i = self.ids.get(token)
        return [i] if i is not None else self.bare.encode(token)

    def border(self, text: str, at: int) -> list[tuple[int, int]]:
        """States at a place: the tokens (start, end) that start before it and end at it or later."""
        if at <= 0:
            return [(0, 0)]
        return [(s, e) for s in range(max(0, at - self.longest), at) for e in self.tokens_at(text, s) if e >= at]

    def reach(self, text: str, state: tuple[int, int], stop: int) -> dict[tuple[int, int], tuple[int, int] | None]:
        """All tokens on valid walks from a state on, up to those that cover or touch stop, each with its predecessor."""
        seen: dict = {state: None}
        todo = [state]
        while todo:
            s, e = todo.pop()
            if e >= stop and (s < stop or e == 0):
                if e > 0 or stop <= 0:
                    continue
            for e2 in self.tokens_at(text, e):
                nxt = (e, e2)
                if nxt not in seen and (e == s or self.stable(text[s:e], text[e:e2])):
                    seen[nxt] = (s, e)
                    todo.append(nxt)
        return seen

    def cuts(self, text: str, a: int, b: int) -> tuple[int, int] | None:
        """First and last place strictly inside (a, b) where every encoding has a border."""
        if not self.by_word:
            return None
        found = [m.start() for m in ATOM.finditer(text, a) if a < m.start() < b and _cut(text, m.start())]
        return (found[0], found[-1]) if found else None

    def transfer(self, text: str, a: int, b: int) -> list[tuple[list, list]]:
        """The chunk's boundary-state matrix over (max, +) with weights 0 and minus infinity, as groups of entry states with
        equal rows: (entry states, exit states). States are token borders relative to a, and to b."""
        last = b >= len(text)
        ends = lambda seen: sorted({(s - b, e - b) for s, e in seen if s < b <= e and (not last or e == b)})
        cut = self.cuts(text, a, b)
        if cut:
            first, final = cut
            ins = [q for q in self.border(text, a) if q[1] <= first and any(e == first for _, e in self.reach(text, q, first))]
            outs = ends(self.reach(text, (final, final), b))
            return [([(s - a, e - a) for s, e in ins], outs)]
        rows: dict = {}
        for q in self.border(text, a):
            outs = [(q[0] - b, q[1] - b)] if q[1] >= b and (not last or q[1] == b) and q[1] > 0 else ends(self.reach(text, q, b))
            if outs:
                rows.setdefault(tuple(outs), []).append((q[0] - a, q[1] - a))
        return [(ins, list(outs)) for outs, ins in rows.items()]

    def backtrace(self, text: str, a: int, b: int, enter: tuple[int, int], leave: tuple[int, int]) -> list[int]:
        """Ids of the tokens that start in [a, b), between the states found for both borders."""
        enter, leave = (enter[0] + a, enter[1] + a), (leave[0] + b, leave[1] + b)
        if enter == leave:
            return []
        cut = self.cuts(text, a, b)
        if not cut:
            return self._walk(text, enter, leave)
        first, final = cut
        head = [] if enter[1] == first else self._walk(text, enter, self._ending(text, enter, first))
        tail = self._walk(text, (final, final), leave)
        return head + self.encode_normal(text[first:final]) + tail

    def _ending(self, text: str, enter: tuple[int, int], at: int) -> tuple[int, int]:
        return next((s, e) for s, e in self.reach(text, enter, at) if e == at)

    def _walk(self, text: str, enter: tuple[int, int], leave: tuple[int, int]) -> list[int]:
        back, path, node = self.reach(text, enter, leave[1]), [], leave
        while node != enter:
            path.append(text[node[0] : node[1]])
            node = back[node]
        return [i for t in reversed(path) for i in self.spell(t)]


def _cut(text: str, at: int) -> bool:
    return text[at] == "\n" or text[at - 1] == "\n" or (text[at] == SPACE and text[at - 1] != SPACE)


def compose(a: list, b: list) -> list:
    """Product of two boundary-state matrices; associative."""
    out: dict = {}
    for ins, mid in a:
        reached = set(mid)
        outs = sorted({q for ins2, outs2 in b if reached & set(ins2) for q in outs2})
        if outs:
            out.setdefault(tuple(outs), []).extend(ins)
    return [(ins, list(outs)) for outs, ins in out.items()]


def borders(chunks: list[list]) -> list[tuple[int, int]]:
    """The one state at each border: reached from the start and leading to the end."""
    ahead = [{(0, 0)}]
    for rows in chunks:
        ahead.append({q for ins, outs in rows if ahead[-1] & set(ins) for q in outs})
    back = ahead[-1]
    found = [next(iter(back))]
    for k in range(len(chunks) - 1, -1, -1):
        back = {q for ins, outs in chunks[k] if back & set(outs) for q in ins} & ahead[k]
        found.append(next(iter(back)))
        back = {found[-1]}
    return found[::-1]

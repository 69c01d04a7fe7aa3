import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np

from quarry.llm import repeats


def words_of(r, n, letters):
    return [r.choice(letters) for _ in range(n)]


def test_runs_against_brute_force():
    r = random.Random(7)
    for trial in range(300):
        w = []
        while len(w) < r.choice([0, 10, 60, 150]):
            if r.random() < 0.5:
                unit = words_of(r, r.choice([1, 1, 2, 3, 4, 7, 9, 15]), "ab" if r.random() < 0.5 else "abcdefgh")
                w += (unit * 30)[: r.randint(5, 60)]
            else:
                w += words_of(r, r.randint(0, 20), "ab" if r.random() < 0.3 else "abcdefghijk")
        ids = np.array([ord(c) for c in w], np.int32)
        assert repeats.runs_of(ids) == repeats.brute_force(w), w
        assert repeats.runs_of(ids, 4, 3) == repeats.brute_force(w, 4, 3), w


def test_grids_of_one_period_and_long_texts(monkeypatch):
    w = np.tile(np.arange(50, dtype=np.int32), 5000)
    assert repeats.runs_of(w) == [(0, 250_000, 50)]
    assert repeats.runs_of(np.zeros(1_000_000, np.int32)) == [(0, 1_000_000, 1)]
    monkeypatch.setattr(repeats, "GRID", 16)
    w = np.concatenate([np.arange(100), np.tile(np.arange(7), 20), np.arange(200, 260), np.tile(np.arange(31), 4)]).astype(np.int32)
    assert repeats.runs_of(w) == [(100, 140, 7), (300, 124, 31)]


def test_pieces_cut_at_white_space(monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 5)
    text = "aa b \t ccccccccccc aa b\x1cd\n\nccccccccccc é ".encode()
    ids, words = repeats.numbered(text)
    assert [words[i] for i in ids] == text.split()


def planted(doc_id, text):
    w = (text or "").encode().split()
    if doc_id is None:
        return w
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]


def test_query_against_brute_force(spark):
    r = random.Random(3)
    rows = [(i, " ".join(words_of(r, r.choice([0, 1, 5, 30, 90, 140]), ["x", "y", "zz", "é"] if i % 3 else [f"w{k}" for k in range(40)]))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, " \n"), (None, "a " * 40), (None, None), (503, "b c\t" * 30), (503, "b c\t" * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS runs", "2 AS n_words", "'c' AS collapsed", "3 AS length")
    found = repeats.with_repeats(repeats.with_planted(docs))
    assert found.columns == ["doc_id", "text", "length", "n_words", "runs", "collapsed"]
    got = sorted(map(repr, (tuple(x) for x in repeats.digests(found).collect())))
    want = []
    for i, t in rows:
        w = planted(i, t)
        runs = repeats.brute_force(w)
        drop = {k for s, n, p in runs for k in range(s + p, s + n)}
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        left = b" ".join(x for k, x in enumerate(w) if k not in drop)
        want.append((i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest()))
    assert got == sorted(map(repr, want))
    assert sum(x[1] > 0 for x in want) > 10
    assert repeats.with_repeats(docs.where("doc_id < 0")).count() == 0

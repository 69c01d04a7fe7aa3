import random

from quarry.llm.pieces import Vocabulary, borders, compose, default_model
from quarry.llm.sentencepiece_codec import decode, encode, scan
from quarry.llm.token_counts import token_counts

WORDS = ["the", "hello", "antidisestablishment", "ção", "日本語", "😀", "==", "    ", "\n", "\t", "▁", "<s>", "</s>", "<0x0A>", "1234567", "aaaaaaa", "----", " "]


def texts(n, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice(WORDS) + (" " if r.random() < gap else "") for _ in range(r.randint(0, 120))) for gap in r.choices([0, 0.1, 0.5, 1], k=n)]


def test_windows_and_chunks_give_the_library_encoding():
    v = Vocabulary(default_model())
    for i, t in enumerate(texts(150)):
        want = v.full.encode(t)
        assert v.count(t, window=(20, 50, 200)[i % 3], overlap=(2, 8, 16)[i % 3]) == len(want)
        normal, size = v.normalize(t), (5, 17, 64)[i % 3]
        spots = list(range(0, len(normal), size))
        if spots:
            matrices = [v.transfer(normal, a, min(a + size, len(normal))) for a in spots]
            at = borders(matrices)
            assert at == scan(matrices)
            assert [x for k, a in enumerate(spots) for x in v.backtrace(normal, a, min(a + size, len(normal)), at[k], at[k + 1])] == want


def test_matrix_product_is_associative():
    v = Vocabulary(default_model())
    normal = v.normalize("abcdefgh" * 30)
    a, b, c = (v.transfer(normal, k, k + 20) for k in (20, 40, 60))
    flat = lambda m: {(i, o) for ins, outs in m for i in ins for o in outs}
    assert flat(compose(compose(a, b), c)) == flat(compose(a, compose(b, c)))


def test_a_long_word_and_many_blocks():
    v = Vocabulary(default_model())
    t = "".join(random.Random(1).choice("abcdefgh") for _ in range(3000))
    normal = v.normalize(t)
    spots = list(range(0, len(normal), 30))
    matrices = [v.transfer(normal, a, min(a + 30, len(normal))) for a in spots]
    at = scan(matrices)
    assert [x for k, a in enumerate(spots) for x in v.backtrace(normal, a, min(a + 30, len(normal)), at[k], at[k + 1])] == v.full.encode(t)
    assert v.count(t, window=256, overlap=1) == len(v.full.encode(t))


def test_operators_on_odd_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "x" * 300), (2, None), (3, ""), (4, "word " * 500), (5, "  \n ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS n_tokens", "2 AS piece_ids")
    v = Vocabulary(default_model())
    want = sorted((len(v.full.encode(t or "")), len((t or "").encode())) for _, t in rows)
    got = token_counts(df, window=64, overlap=4, limit=400).collect()
    assert sorted((r.n_tokens, r.n_bytes) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 400) for r in got)
    coded = decode(encode(df, chunk=50, giant=100)).collect()
    assert sorted(list(r.piece_ids) for r in coded) == sorted(v.full.encode(t or "") for _, t in rows)
    assert all(r.decoded == r.text for r in coded)
    empty = df.where("doc_id > 99")
    assert token_counts(empty).count() == 0 and encode(empty).count() == 0

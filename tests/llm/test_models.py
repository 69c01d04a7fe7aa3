"""The models recomputed in plain Python: expectation-maximisation row by row, evidence fused page by page, gradients by differences."""

import math
import random

import numpy as np
import pytest

import corpus_pipeline
from quarry.llm import chat_format, exact_dedup, jaccard_join, language, quality, toxicity


def test_expectation_maximisation_row_by_row():
    r = random.Random(4)
    rows = []
    for _ in range(400):
        good = r.random() < 0.7
        rows.append([r.choice([quality.GOOD, quality.NONE] if good else [quality.BAD, quality.BAD, quality.NONE]) if r.random() < 0.8 else r.randrange(3) for _ in range(4)])
    patterns, counts = np.unique(np.array(rows), axis=0, return_counts=True)
    table, share, post = quality.estimate(patterns, counts.astype(float), rounds=60)
    # the same, a row at a time
    p = [0.1 if quality.BAD in row else 0.9 for row in rows]
    for _ in range(60):
        prior = min(0.98, max(0.02, sum(p) / len(p)))
        t = [[[0.5] * 3 for _ in range(4)] for _ in range(2)]
        for row, w in zip(rows, p):
            for k, v in enumerate(row):
                t[1][k][v] += w
                t[0][k][v] += 1 - w
        t = [[[x / sum(cell) for x in cell] for cell in c] for c in t]
        new = []
        for row in rows:
            odds = math.log(prior / (1 - prior)) + sum(math.log(t[1][k][v] / t[0][k][v]) for k, v in enumerate(row))
            new.append(1 / (1 + math.exp(-max(-40, min(40, odds)))))
        done = max(abs(a - b) for a, b in zip(p, new)) < 1e-7
        p = p if done else new
        if done:
            break
    by = {tuple(x): q for x, q in zip(patterns.tolist(), post)}
    assert all(abs(by[tuple(row)] - q) < 1e-6 for row, q in zip(rows, p)) and abs(share - prior) < 1e-6


def test_labellers_vote_at_every_length():
    word = lambda i: f"wort{i:x}"
    for n in (100, 2999, 3005, 20000):
        assert quality.votes(" ".join(["again and"] * (n // 2)))[6] == quality.BAD
        assert quality.votes(" ".join(word(i % 900) for i in range(n)))[6] == quality.GOOD


def test_scorer_separates_what_it_was_fitted_to():
    good, bad = (np.array([1, 2]), np.array([0.5, 0.1])), (np.array([2, 3]), np.array([0.1, 0.5]))
    w = quality.fit([good, bad] * 20, np.array([0.9, 0.1] * 20))
    score = lambda f: 1 / (1 + math.exp(-(w[f[0]] @ f[1] + w[-1])))
    assert score(good) > 0.8 and score(bad) < 0.2


def pages_and_docs(spark):
    en, de = "the and of that with for was this from have which ", "der und die das mit für ist nicht eine auch über "
    docs = spark.createDataFrame([(i, (en if i % 2 else de) * 5, "en" if i % 2 else "de") for i in range(60)] + [(900, None, "en"), (901, "x", None)], "doc_id long, text string, lang string")
    r = random.Random(8)
    rows = []
    for i in range(60):
        own = de if i % 3 else en
        said = r.choice(["", ' lang="de"', ' lang="en-GB"'])
        host = r.choice(["a.one.de", "b.one.de", "two.uk", "three.com", ""])
        rows.append((i, f"http://{host}/{i}" if host else None, f"<html{said}><p>{' '.join(r.sample(own.split(), 3))} {'x' * i}</p></html>"))
    rows += [(5, "http://two.uk/5", "<html><p>und</p></html>"), (5, "http://two.uk/5", "<html><p>und</p></html>"), (61, None, None), (62, "odd", "<p>" + "und der " * 20_000 + "</p>"), (None, "http://two.uk", "")]
    return spark.createDataFrame(rows, "page_id long, url string, html string"), docs, rows


def test_evidence_fused_page_by_page(spark):
    pages, docs, rows = pages_and_docs(spark)
    got = sorted((str(g.page_id), g.lang, g.declared, g.host, round(g.confidence, 6)) for g in language.identify(pages, docs).collect())
    langs, table = language.train(docs)
    read = []
    for page, url, html in rows:
        m = language.HOST.match(url or "")
        host = m[1].lower().strip(".") if m else ""
        said, text = language.parts(html or "")
        ll = table[:, language.grams(text)].sum(axis=1) * language.TEMPER
        p = np.exp(ll - ll.max())
        labels = host.split(".")
        read.append((page, host, ".".join(labels[-2:]), labels[-1], said, ll - ll.max(), p / p.sum()))
    total = sum(x[6] for x in read)
    base = (total + 1) / (total.sum() + len(langs))
    smooth = lambda counts, above: (counts + language.STRENGTH * above) / (counts.sum() + language.STRENGTH)
    weigh = lambda counts: np.log((counts + 1) / (total + len(langs)))
    want = []
    for page, host, domain, suffix, said, ll, p in read:
        others = lambda k, value: np.maximum(0, sum(x[6] for x in read if x[k] == value) - p)  # noqa: E731,B023
        hosts = np.maximum(0, sum(x[6] for x in read if x[1] == host and x[2] == domain) - p)
        prior = smooth(hosts, smooth(others(2, domain), smooth(others(3, suffix), base)))
        odds = ll + np.log(prior) + (weigh(others(4, said)) if said else 0) + weigh(others(3, suffix))
        want.append((str(page), langs[int(np.argmax(odds))], said, host, round(float(1 / np.exp(odds - odds.max()).sum()), 6)))
    assert got == sorted(want)


def test_training_texts_are_those_of_the_smallest_hashes(spark):
    docs = spark.createDataFrame([(i, f"w{i}" if i % 50 else "only", "en" if i % 50 else "rare") for i in range(3000)], "doc_id long, text string, lang string")
    langs, table = language.train(docs, sample=40)
    spots = docs.selectExpr("lang", "text", "xxhash64(doc_id, 'language') AS spot").orderBy("spot").collect()
    want = np.full((2, language.GRAMS), 0.5)
    for k, lang in enumerate(["en", "rare"]):
        for row in [s for s in spots if s.lang == lang][:40]:
            want[k] += np.bincount(language.grams(row.text), minlength=language.GRAMS)
    assert langs == ["en", "rare"] and np.allclose(table, np.log(want / want.sum(axis=1, keepdims=True)))


def test_gradients_of_the_embedding_model():
    r = np.random.default_rng(2)
    e, w, b = r.normal(size=(12, 3)), r.normal(size=(3, 2)), r.normal(size=2)
    sizes, labels = np.array([3, 1, 4]), np.array([0, 1, 1])
    at, x = np.array([0, 5, 5, 7, 1, 2, 3, 0]), r.random(8)
    _, used, de, dw, db = toxicity.loss(e, w, b, at, x, sizes, labels)
    full = np.zeros_like(e)
    full[used] = de
    for array, gradient in ((e, full), (w, dw), (b, db)):
        for i in np.ndindex(array.shape):
            old = array[i]
            sides = []
            for step in (1e-5, -1e-5):
                array[i] = old + step
                sides.append(toxicity.loss(e, w, b, at, x, sizes, labels)[0])
            array[i] = old
            assert abs((sides[0] - sides[1]) / 2e-5 - gradient[i]) < 1e-6


def test_informative_buckets_are_those_that_tell_classes_apart():
    r = np.random.default_rng(3)
    x = [r.random((30, 6)) for _ in range(2)]
    x[1][:, 4] += 2
    x[0][:, 1] += 0.7
    got = toxicity.informative(np.stack([v.sum(axis=0) for v in x]), np.stack([(v**2).sum(axis=0) for v in x]), np.array([30, 30]), most=2)
    assert got.tolist() == [1, 4]


@pytest.mark.parametrize("labels, score", [([0, 0, 0], lambda s: s < 0.5), ([1, 1, 1], lambda s: s > 0.5), ([None, 7, None], lambda s: s == 0.5)])
def test_toxicity_of_one_class_repeated_ids_and_long_texts(spark, labels, score):
    long = " ".join(f"word{i}" for i in range(20_000))
    docs = spark.createDataFrame([(1, "a b"), (1, "a c"), (1, "a b"), (2, long), (3, ""), (4, None), (None, "a")], "doc_id long, text string").selectExpr("*", "0.0 AS score", "1 AS toxic")
    known = spark.createDataFrame(list(zip([1, 2, 3], labels)), "doc_id long, toxic int")
    got = toxicity.toxicity(docs, known).collect()
    assert len(got) == 7 and all(score(g.score) for g in got if g.doc_id in (1, 3, 4)) and all(0 <= g.score <= 1 for g in got)


def test_a_log_folds_back_to_its_turns(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", "x" * n + "é") for t, n in enumerate(range(12))] + [(2, 0, None, None), (2, 0, "user", "same"), (2, 0, "user", "same"), (2, 0, "user", "othr"), (None, None, "user", "<|im_end|>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS seq", "'k' AS kind", "2 AS nth")
    events = chat_format.as_events(df)
    assert {r.kind for r in events.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    got = sorted((str(g.conv_id), str(g.turn), g.role, g.text) for g in chat_format.messages(events).collect())
    assert got == sorted((str(c), str(t), r or "", x or "") for c, t, r, x in rows)
    assert chat_format.messages(chat_format.as_events(df.where("conv_id = 99"))).count() == 0


def test_blocks_that_share_a_digest_go_by_their_bytes(spark, monkeypatch):
    real = exact_dedup._blocks

    def one_digest(docs, block):
        return real(docs, block).withColumn("digest", exact_dedup.F.lit(b"same"))

    monkeypatch.setattr(exact_dedup, "_blocks", one_digest)
    texts = ["aaaa", "aaab", "aaaa", "aaaabbbb", "aaaabbbc", "aaaabbbb", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {g.doc_id: (g.keep_id, g.group_size) for g in exact_dedup.exact_dedup(df, block=4).collect()}
    assert got == {0: (0, 2), 1: (1, 1), 2: (0, 2), 3: (3, 2), 4: (4, 1), 5: (3, 2), 6: (6, 2), 7: (6, 2)}


WORDS = [f"w{i}" for i in range(30)]


def test_near_copies_go_by_id_and_text(spark):
    base, other = " ".join(WORDS), " ".join(f"v{i}" for i in range(30))
    near = base + " end"
    rows = [(1, base), (2, near), (2, other), (None, base + " stop"), (None, other + " x y z"), (3, "one"), (4, None), (4, None), (5, ""), (1, base), (6, near)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(g.doc_id, g.text) for g in corpus_pipeline.without_near_copies(spark, docs, "").collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, base), (2, other), (3, "one"), (4, None), (4, None), (5, "")]))


def test_pipeline_stages_take_empty_tables_nulls_and_repeats(spark):
    text = "Some plain words stand here, and they are enough. " * 4
    rows = [(None, text, None, None, None), (None, text + "More.", None, None, None), (1, text + "one", "en", "a", 3), (1, text + "one", "en", "a", 3), (2, None, None, None, None), (3, "", "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("doc_id > 99"), "").count() == 0
        assert stage(spark, docs, "").count() >= 0
        assert stage(spark, docs.where("doc_id IS NULL"), "").count() <= 4


def test_links_of_every_width_are_found(spark):
    r = random.Random(11)
    rows = []
    for n in (6, 30, 300, 900, 1100, 4000):
        base = [f"{r.randrange(10**6)}" for _ in range(n)]
        for k in (0, 0.01, 0.02, 0.3):
            w = list(base)
            for _ in range(int(k * n / 5 + 0.99)):
                w[r.randrange(n)] = f"x{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
        rows.append((len(rows), " ".join(base + [f"y{i}" for i in range(n // 6)])))
    shared = [f"p{i}" for i in range(60)]
    rows += [(1000 + k, " ".join(shared + [f"q{k}.{i}" for i in range(10 + k)])) for k in range(40)]
    got = {g.doc_id: (g.n_shingles, g.component_id) for g in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == jaccard_join.brute_force(rows)

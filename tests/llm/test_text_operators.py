import hashlib
import os
import random
import re

import numpy as np

from quarry.llm import chat_format, exact_dedup, jaccard_join, language, mixing, neighbours, quality, toxicity


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'x' AS name", "1 AS size", "2 AS level", "true AS kept")


def test_exact_dedup_against_brute_force(spark):
    r = random.Random(2)
    texts = ["".join(r.choice("ab \n\té") for _ in range(n)) for n in (0, 1, 3, 7, 8, 9, 40, 41, 200, 1000) for _ in range(4)]
    rows = [(i, r.choice(texts), "s") for i in range(120)] + [(200, None, None), (7, None, "s"), (None, "z", "s"), (None, "z", "s"), (201, "q", "s"), (201, "q", "s")]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    got = exact_dedup.exact_dedup(documents(spark, rows), block=8).collect()
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(norm(t), []).append(i)
    want = sorted((str(i), str(min((x for x in groups[norm(t)] if x is not None), default=None)), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t, _ in rows)
    assert sorted((str(g.doc_id), str(g.keep_id), g.group_size, g.text_sha256) for g in got) == want
    assert sum(g.kept for g in got) == len(groups)
    left = exact_dedup.without_copies(documents(spark, rows), block=8).collect()
    assert len(left) == len(groups) and {norm(x.text) for x in left} == set(groups)
    assert exact_dedup.exact_dedup(documents(spark, rows).where("doc_id > 999")).count() == 0


def near_copies(seed=5):
    r, rows = random.Random(seed), []
    words = [f"w{i}" for i in range(60)]
    for _ in range(10):
        base = [r.choice(words) for _ in range(r.choice([3, 5, 8, 40, 120]))]
        for _ in range(r.choice([1, 2, 6, 20])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                w[r.randrange(len(w))] = r.choice(words)
            rows.append((len(rows), " ".join(w).upper() if r.random() < 0.2 else "\n ".join(w)))
    n = len(rows)
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "two words")]


def test_jaccard_join_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    monkeypatch.setattr(jaccard_join, "LEAF", 2)
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS token", "3 AS node", "4 AS comp")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(df).collect()}
    assert got == jaccard_join.brute_force(rows)
    assert jaccard_join.jaccard_components(df.where("doc_id < 0")).count() == 0


def test_dual_traversal_loses_no_link():
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 2**63, 80, dtype=np.uint64)) for _ in range(6)]
    sets = [np.unique(np.concatenate([s[r.random(len(s)) > 0.05], r.integers(0, 2**63, 3, dtype=np.uint64)])) for s in sets for _ in range(12)]
    sets += [np.unique(r.integers(0, 2**63, k, dtype=np.uint64)) for k in (250, 260, 600, 5000, 5000, 5100)]
    sets += [np.append(s, np.uint64(7)) for s in sets[-6:]]
    n = np.array([len(s) for s in sets])
    bits, every = [jaccard_join.signature(s) for s in sets], np.arange(len(sets))
    sides = [np.full(len(sets), -1), every % 2]
    whole, halves = (set(zip(*map(list, jaccard_join.tree_pairs(np.zeros(len(sets), np.int64), side, every, n, every, bits)[:2]))) for side in sides)
    assert halves == {(i, j) for i, j in whole if i % 2 != j % 2}
    found = whole
    links = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert links and links <= found and len(found) < len(sets) * (len(sets) - 1) / 4


def test_chat_round_trip_and_folding(spark):
    rows = [
        (1, 0, "message", 0, "user", "hi <|im_end|> <\\|x <\\\\| a&b\\"), (1, 1, "delta", 1, "assistant", "Hel"), (1, 2, "delta", 1, None, "lo"), (1, 3, "regenerate", 1, None, None), (1, 4, "delta", 1, None, "New "),
        (1, 5, "delta", 1, None, "<|im_start|>"), (1, 6, "edit", 0, None, "edited"), (2, 0, "message", 0, "a\n&b", None), (2, 0, "message", 0, "a\n&b", None), (None, 1, None, None, None, "x"),
    ]
    events = spark.createDataFrame(rows, "conv_id long, seq long, kind string, turn long, role string, text string")
    out = {r.conv_id: r for r in chat_format.render(chat_format.messages(events)).select("*", chat_format.read_back(chat_format.F.col("formatted")).alias("turns"), chat_format.learnt_text(chat_format.F.col("formatted"), chat_format.F.col("loss")).alias("learnt")).collect()}
    assert [tuple(t) for t in out[1].turns] == [("user", "edited"), ("assistant", "New <|im_start|>")]
    assert out[1].learnt == "New <|im_start|>" and out[1].formatted.count("<|im_start|>") == 2
    assert [tuple(t) for t in out[2].turns] == [("a\n&b", "")] * 2 and [tuple(t) for t in out[None].turns] == [("", "x")]
    raw = chat_format.render(chat_format.messages(events.where("seq = 0"))).select(chat_format.read_back(chat_format.F.col("formatted"))[0]["text"].alias("t"), "conv_id").collect()
    assert {r.conv_id: r.t for r in raw}[1] == rows[0][5]
    assert chat_format.render(chat_format.messages(events.where("seq > 99"))).count() == 0


def test_mixing_reaches_targets(spark):
    r = random.Random(9)
    rows = [(i, " ".join("w" * r.randint(1, 40) for _ in range(r.randint(0, 60))), r.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(400)] + [(5, "x y z", "a"), (5, "x y z", "a"), (None, None, "b"), (401, "", "e")]
    df = documents(spark, rows)
    got = mixing.mix_sizes(df, bins=7).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sizes(df, bins=7).collect()))
    total = sum(g["size"] for g in got)
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    left, want, open_ = 1.5 * total, {}, set(sources)
    while open_:
        rate = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * rate >= 2 * size[s]}
        want |= {s: 2.0 * size[s] for s in full} if full else {s: weight[s] * rate for s in open_}
        left -= sum(2 * size[s] for s in full)
        open_ = open_ - full if full else set()
    by = {}
    for g in mixing.mix(df, bins=7).collect():
        assert 0 <= g.taken <= 2 * g["size"]
        by.setdefault(g.source, []).append(g)
    for s, gs in by.items():
        assert abs(gs[0].target - want[s]) < 1e-6 and abs(sum(g.taken for g in gs) - want[s]) <= 2
    assert mixing.mix_sizes(df.where("doc_id > 999")).count() == 0


def test_heavier_documents_come_first(spark):
    rows = [(i, ("good words " if i % 2 else "#### %%%% ") * 20, "a" if i < 900 else "b") for i in range(1000)]
    got = mixing.mix(documents(spark, rows), weights=(1, 8)).where("source = 'a'").collect()
    extra = [g.taken - g.whole_epochs * g["size"] for g in got]
    assert sum(e for e, g in zip(extra, got) if g.doc_id % 2) > 2 * sum(e for e, g in zip(extra, got) if not g.doc_id % 2)


def test_quality_separates_junk(spark):
    r = random.Random(1)
    words = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 9))) for _ in range(300)]
    clean = [" ".join(r.choice(words) + ("." if r.random() < 0.1 else "") for _ in range(60)).capitalize() for _ in range(240)]
    junk = [" ".join(r.choice(words) + "***$$$" for _ in range(60)) for _ in range(15)] + [" ".join(r.choice(words).upper() + "!!" for _ in range(60)) for _ in range(15)] + [" ".join(w for w in r.choices(words, k=6) for _ in range(12)) for _ in range(15)]
    rows = [(i, t, "s") for i, t in enumerate(clean + junk)] + [(None, None, None), (900, " \n", "s"), (901, "", "s")]
    got = {g.doc_id: g for g in quality.classify(documents(spark, rows), sample=200).collect()}
    assert all(got[i].accepted for i in range(240)) and not any(got[i].accepted for i in range(240, 285))
    assert got[900].quality == 0 and not got[None].accepted and got[3].name == "x"
    assert quality.classify(documents(spark, rows).where("doc_id > 999")).count() == 0


def test_toxicity_knows_unseen_spellings(spark):
    r = random.Random(3)
    plain = ["river", "stone", "light", "window", "garden", "letter", "mountain", "paper"]
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        w = [r.choice(plain) for _ in range(20)] + (["vilegrub" + r.choice(["a", "os", "ent", "ing"])] * 2 if bad else [])
        r.shuffle(w)
        rows.append((i, " ".join(w), "s"))
        labels.append((i, int(bad)))
    rows += [(1000, "river stone vilegrubzz light vilegrubzz paper", "s"), (1001, "river stone light", "s"), (1002, None, "s"), (None, "", "s")]
    known = spark.createDataFrame([*labels, (5, None), (None, 1), (6, 7)], "doc_id long, toxic int")
    got = {g.doc_id: g for g in toxicity.toxicity(documents(spark, rows), known).collect()}
    assert got[1000].predicted == 1 and got[1001].predicted == 0 and 0 <= got[1002].score <= 1
    out = [g for i, g in got.items() if i is not None and i < 300 and g.held_out]
    assert out and sum(g.predicted == labels[g.doc_id][1] for g in out) / len(out) > 0.95
    assert toxicity.toxicity(documents(spark, rows), known.where("doc_id > 99999")).count() == len(rows)


def test_language_fuses_evidence(spark):
    en, de = "the and of that with for was this from have which ", "der und die das mit für ist nicht eine auch über "
    docs = spark.createDataFrame([(i, (en if i % 2 else de) * 5, "en" if i % 2 else "de") for i in range(40)], "doc_id long, text string, lang string")
    page = lambda t, lang="": f"<html{lang}><script>var der=1;</script><nav>{en}</nav><p>{t}</p></html>"
    rows = [(i, f"http://a.site.de/{i}", page(de)) for i in range(30)] + [(100, "http://a.site.de/x", page("xq")), (101, "http://b.site.uk/", page(en * 3, ' lang="en"')), (102, None, None), (103, "odd", page(de, " lang='de'"))]
    got = {g.page_id: g for g in language.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()}
    assert got[0].lang == "de" and got[100].lang == "de" and got[101].lang == "en" and got[103].declared == "de" and got[102].host == ""
    assert len(got) == len(rows) and language.identify(spark.createDataFrame([], "page_id long, url string, html string"), docs).count() == 0


def test_neighbours_against_brute_force(spark):
    r = np.random.default_rng(8)
    base = r.normal(size=(40, 12))
    x = base[r.integers(0, 40, 1500)] + 0.15 * r.normal(size=(1500, 12))
    x[500:560] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(2000, None), (2100, [0.0] * 12), (2200, [float("nan")] * 12), (2300, [None] + [1.0] * 11), (2400, [1.0]), (None, [1.0] * 12)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").selectExpr("*", "1 AS rank", "2 AS score")
    got = {}
    for g in neighbours.nearest(df, every=50).orderBy("query_id", "rank").collect():
        got.setdefault(g.query_id, []).append((g.vec_id, g.score))
    want = neighbours.brute_force(np.arange(1500), x, every=50)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 10 for q in want]) >= 0.9
    assert got[0] == [(i, 0.0) for i in range(500, 510)]
    few = neighbours.nearest(df.where("vec_id < 4"), every=2).collect()
    assert sorted((g.query_id, g.rank) for g in few) == [(0, 1), (0, 2), (0, 3), (2, 1), (2, 2), (2, 3)]
    assert neighbours.nearest(df.where("vec_id > 9999")).count() == 0


def directions(spark, n, dims):
    x = np.random.default_rng(4).normal(size=(n, dims)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    return x.astype(np.float64), spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")


def test_neighbours_write_each_vector_a_few_times(spark):
    _, df = directions(spark, 8000, 64)
    local = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f: os.path.getsize(f) for top in [*local, spark.conf.get("spark.checkpoint.dir").removeprefix("file://")] for d, _, names in os.walk(top) for f in (os.path.join(d, x) for x in names)}
    before = files()
    assert neighbours.nearest(df).count() == 800
    assert sum(size for f, size in files().items() if f not in before) < 4 * 8000 * 64 * 4


def test_neighbours_in_shards_and_chunks_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 1)
    monkeypatch.setattr(neighbours, "CHUNK", 1)
    monkeypatch.setattr(neighbours, "SAMPLE", 500)
    x, df = directions(spark, 4000, 16)
    got = {}
    for g in neighbours.nearest(df, every=5).orderBy("query_id", "rank").collect():
        got.setdefault(g.query_id, []).append((g.vec_id, g.score))
    want = neighbours.brute_force(np.arange(4000), x, every=5)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert all(s == np.sqrt(((x[i] - x[q]) ** 2).sum()) for q, v in got.items() for i, s in v)
    assert np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 10 for q in want]) >= 0.9

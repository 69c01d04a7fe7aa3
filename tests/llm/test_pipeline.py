import random
import re

import corpus_pipeline
from quarry.llm.jaccard_join import brute_force
from quarry.llm.pieces import Vocabulary, default_model


def test_stages_against_brute_force(spark, tmp_path):
    r = random.Random(6)
    words = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 9))) for _ in range(400)]
    clean = [" ".join(r.choices(words, k=60)) + "." for _ in range(60)]
    near = [t.replace(t.split()[30], "changed", 1) for t in clean[:5]]
    junk = [" ".join(w + "***$$$" for w in r.choices(words, k=60)) for _ in range(12)]
    texts = clean + [t.replace(" ", "\n ") for t in clean[5:10]] + near + junk + ["", None]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept[-1], str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        kept.append(spark.read.parquet(f"{tmp_path}/{k}"))
    good, alone, apart, mixed, coded = ([x.asDict() for x in d.collect()] for d in kept[1:])
    assert {x["doc_id"] for x in good} == set(range(70))
    assert {x["doc_id"] for x in alone} == set(range(60)) | set(range(65, 70))
    want = brute_force([(x["doc_id"], x["text"]) for x in alone])
    assert {x["doc_id"] for x in apart} == {c for _, c in want.values()} and len(apart) < len(alone)
    size = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", x["text"])) for x in rows)
    assert abs(size(mixed) - 1.5 * size(apart)) <= 3 and list(mixed[0]) == ["doc_id", "text", "lang", "source", "n_chars"]
    v = Vocabulary(default_model())
    assert sorted(map(list, (x["piece_ids"] for x in coded))) == sorted(v.full.encode(x["text"]) for x in mixed)

"""How far the sources of a language differ: chi-square-like distances of term probabilities, in whole numbers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Documents of its language that a term has to be in, terms reported of a group, what a probability of one is.
DOCS, TOP, ONE = 3, 200, 1_000_000_000
#: Distinct (lang, source, term) that a task counts before it hands them on, terms in a batch, sources in a block of postings,
#: pairs of postings at a time; counts that have a bucket each, and buckets in an octave above; how much more terms each round of
#: the search may meet.
HELD, BATCH, BLOCK, PAIRS = 400_000, 50_000, 64, 1 << 19
EXACT, OCTAVE, WIDER = 32, 8, 16
#: Terms consist of letters A-Z, a-z and of all characters beyond ASCII.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text, A-Z lower-cased."""
    return text.translate(TERM_BYTES).split(b" ")


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, d: occurrences and documents of each term in each (lang, source); a row with null term for each
    group, so that none without terms is lost. Tasks count what they read before anything is shuffled."""
    slim = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]).withColumn("text", F.col("text").cast("binary"))

    def emptied(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, docs_) in held.items():
            names, size = [None, *counts], len(counts) + 1
            for lo in range(0, size, BATCH):
                part = names[lo : lo + BATCH]
                n, d = ([c.get(t, 0) for t in part] for c in (counts, docs_))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())], ["lang", "source", "term", "n", "d"])
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for lang, source, text in zip(*(batch.column(i) for i in range(3))):
                counts, docs_ = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                words = Counter(terms_of(text.as_py()))
                words.pop(b"", None)
                counts.update(words)
                docs_.update(words.keys())
            if sum(len(c) for c, _ in held.values()) >= HELD:
                yield from emptied(held)
        yield from emptied(held)

    rows = slim.mapInArrow(run, "lang string, source string, term string, n long, d long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def probability(n: Column | str, total: Column | str, kept: Column | str) -> Column:
    """1 + floor(ONE * (n + 1) / (total + kept)), exact up to counts of 9 billion; null where nothing is kept."""
    n, total, kept = (F.col(c) if isinstance(c, str) else c for c in (n, total, kept))
    over = total + kept
    return F.when(over > 0, 1 + _div(F.lit(ONE).cast("long") * (n + 1), over))


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)"""
    return _div((p - q) * (p - q), q)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _bucket(n: Column) -> Column:
    """The bucket of a count: its own up to EXACT, above one of OCTAVE in an octave."""
    return F.when(n < EXACT, n).otherwise(EXACT + F.floor(OCTAVE * F.log2(n / EXACT))).cast("int")


class Corpus:
    """What both parts need, each written once: postings (lang, source, term, n, all_n; p, q as probabilities) of kept terms, and
    groups (lang, source, nth in its language, total, lang_total, kept, own; p0 of a term that it doesn't have)."""

    def __init__(self, docs: DataFrame, least_docs: int):
        counts = stored(term_counts(docs))
        known = counts.where(F.col("term").isNotNull()).groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("d").alias("d")).where(F.col("d") >= least_docs).drop("d")
        raw = stored(counts.join(known, ["lang", "term"]).select("lang", "source", "term", "n", "all_n"))
        per_group = raw.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("own"))
        # a kept term's occurrences in its language are those of its postings
        per_lang = known.groupBy("lang").agg(F.sum("all_n").alias("lang_total"), F.count(F.lit(1)).alias("kept"))
        groups = counts.where(F.col("term").isNull()).select("lang", "source").join(per_group, ["lang", "source"], "left").join(per_lang, "lang", "left").na.fill(0, ["total", "own", "lang_total", "kept"])
        groups = groups.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
        self.groups = stored(groups.withColumn("p0", probability(F.lit(0).cast("long"), "total", "kept")))
        sized = raw.join(self.groups.select("lang", "source", "nth", "total", "lang_total", "kept", "p0"), ["lang", "source"])
        self.postings = sized.withColumn("p", probability("n", "total", "kept")).withColumn("q", probability("all_n", "lang_total", "kept")).withColumn("bucket", _bucket(F.col("n")))


def strongest_terms(corpus: Corpus, top: int = TOP) -> DataFrame:
    """lang, source, item, value, rank: of each group the `top` terms that it has and that are likelier in it than in the
    language, by value falling, then term.

    A group's terms fall into buckets by their count. A bucket's greatest p and least q bound its values, as the distance grows
    with p and falls with q while p > q. Buckets are met by falling bound, in rounds that each take as many as hold WIDER times
    the terms of the round before; they end where no bucket left has a bound as high as the value of the last term kept, so that
    ties are met too. Rows are ranked where they are before the best of each task are shuffled.
    """
    keys = ["lang", "source"]
    bounds = corpus.postings.groupBy(*keys, "bucket").agg(F.max("p").alias("p"), F.min("q").alias("q"), F.count(F.lit(1)).alias("size")).where("p > q")
    ahead = Window.partitionBy(*keys).orderBy(F.desc("bound"), "bucket")
    open_ = bounds.select(*keys, "bucket", distance(F.col("p"), F.col("q")).alias("bound"), "size")
    open_ = stored(open_.withColumn("before", F.sum("size").over(ahead.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")))
    order = Window.partitionBy(*keys).orderBy(F.desc("value"), "item")
    best, limit = None, top
    while not open_.isEmpty():
        now = open_.where(F.col("before") < limit).select(*keys, "bucket")
        met = corpus.postings.join(now, [*keys, "bucket"], "left_semi").where("p > q").select(*keys, F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
        best = met if best is None else best.unionByName(met)
        best = stored(best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).drop("rank"))
        last = best.groupBy(*keys).agg(F.count(F.lit(1)).alias("have"), F.min("value").alias("last"))
        left = open_.where(F.col("before") >= limit).join(last, keys, "left")
        open_ = stored(left.where(F.col("have").isNull() | (F.col("have") < top) | (F.col("bound") >= F.col("last"))).drop("have", "last"))
        limit *= WIDER
    if best is None:
        return corpus.groups.where("false").select(*keys, F.lit("").alias("item"), F.lit(0).cast("long").alias("value"), F.lit(0).alias("rank"))
    return best.withColumn("rank", F.row_number().over(order)).select(*keys, "item", "value", "rank")


def _shared(corpus: Corpus) -> DataFrame:
    """lang, a, b, part: over the terms that sources number a and b both have, by how much their distance exceeds what both
    would add by themselves. Postings of a term come in blocks of BLOCK sources; two blocks meet as one row, and their pairs are
    summed as arrays before anything is shuffled."""
    placed = corpus.postings.select("lang", "term", "nth", "p", "p0").repartition("lang", "term")
    block = F.floor(F.col("nth") / BLOCK).cast("int")
    blocks = placed.groupBy("lang", "term", block.alias("block")).agg(F.collect_list("nth").alias("s"), F.collect_list("p").alias("p"), F.collect_list("p0").alias("z"))
    one, two = (blocks.select("lang", "term", *[F.col(c).alias(f"{c}{k}") for c in ("block", "s", "p", "z")]) for k in (1, 2))
    met = one.join(two, ["lang", "term"]).where("block1 <= block2 AND (block1 < block2 OR size(s1) > 1)").drop("term")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spots: dict = {}
        sums = np.zeros(0, np.int64)
        for batch in batches:
            at = np.array([spots.setdefault(key, len(spots)) for key in zip(*(batch.column(c).to_pylist() for c in ("lang", "block1", "block2")))], np.int64)
            if len(spots) * BLOCK * BLOCK > len(sums):
                sums = np.concatenate([sums, np.zeros(2 * len(spots) * BLOCK * BLOCK - len(sums), np.int64)])
            left, right = ([batch.column(f"{c}{k}").flatten().to_numpy() for c in ("s", "p", "z")] for k in (1, 2))
            m, n = (batch.column(f"s{k}").value_lengths().to_numpy().astype(np.int64) for k in (1, 2))
            from1, from2, ends = np.cumsum(m) - m, np.cumsum(n) - n, np.cumsum(m * n)
            lo = 0
            while lo < len(at):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right")))
                row = np.repeat(np.arange(lo, hi), (m * n)[lo:hi])
                k = np.arange(len(row)) - np.repeat(np.cumsum((m * n)[lo:hi]) - (m * n)[lo:hi], (m * n)[lo:hi])
                i, j = from1[row] + k // n[row], from2[row] + k % n[row]
                (s, p, z), (t, q, y) = (c[i] for c in left), (c[j] for c in right)
                far = lambda a, b: (a - b) ** 2 // b
                spot = at[row] * BLOCK * BLOCK
                np.add.at(sums, spot + s % BLOCK * BLOCK + t % BLOCK, far(p, q) - far(p, y) - far(z, q) + far(z, y))
                lo = hi
        for (lang, one, two), spot in spots.items():
            part = sums[spot * BLOCK * BLOCK : (spot + 1) * BLOCK * BLOCK]
            used = np.flatnonzero(part)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(one * BLOCK + used // BLOCK, pa.int64()), pa.array(two * BLOCK + used % BLOCK, pa.int64()), pa.array(part[used])], ["lang", "a", "b", "part"])

    # distances aren't symmetric: blocks that differ meet in both orders
    return met.unionByName(met.where("block1 < block2").select("lang", *[F.col(f"{c}{3 - k}").alias(f"{c}{k}") for k in (1, 2) for c in ("block", "s", "p", "z")])).mapInArrow(run, "lang string, a long, b long, part long").where("a <> b")


def source_pairs(corpus: Corpus) -> DataFrame:
    """lang, source, item, value, rank: of each group its distance to each other source of the language, over all kept terms.

    A pair's sum has a part that goes over the terms of one source only, where the other's probability is that of a term it
    doesn't have: these need the counts of each source's counts. Terms that both have are met through postings, and terms that
    neither has differ in nothing, so the work follows the postings and not the terms times the pairs.
    """
    g = corpus.groups.select("lang", "source", "nth", "p0", "own", "kept")
    other = g.select("lang", F.col("source").alias("item"), F.col("nth").alias("other"), F.col("p0").alias("q0"), F.col("own").alias("other_own"))
    pairs = g.join(other, "lang").where(F.col("nth") != F.col("other"))
    shapes = corpus.postings.groupBy("lang", "source", "nth", "p").agg(F.count(F.lit(1)).alias("size"))
    faced = shapes.join(other, "lang").where(F.col("nth") != F.col("other"))
    near = faced.groupBy("lang", F.col("nth").alias("a"), F.col("other").alias("b")).agg(F.sum(F.col("size") * distance(F.col("p"), F.col("q0"))).alias("part"))
    back = faced.groupBy("lang", F.col("other").alias("a"), F.col("nth").alias("b")).agg(F.sum(F.col("size") * distance(F.col("q0"), F.col("p"))).alias("part"))
    parts = near.unionByName(back).unionByName(_shared(corpus)).groupBy("lang", F.col("a").cast("int").alias("nth"), F.col("b").cast("int").alias("other")).agg(F.sum("part").alias("part"))
    alone = (F.col("kept") - F.col("own") - F.col("other_own")) * F.coalesce(distance(F.col("p0"), F.col("q0")), F.lit(0))
    rows = pairs.join(parts, ["lang", "nth", "other"], "left").select("lang", "source", "item", (alone + F.coalesce("part", F.lit(0))).alias("value"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def divergence(docs: DataFrame, least_docs: int = DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: how (lang, source) groups differ.

    Terms are runs of letters A-Z (lower-cased), a-z and characters beyond ASCII; a language keeps those that are in at least
    `least_docs` of its documents. With n occurrences of a kept term, N of all of them and V of them, its probability in a group
    or a language is p = 1 + floor(10^9 (n + 1) / (N + V)); two differ by floor((p - q)^2 / q). Part `pair`: each other source of
    the language, with the sum over all kept terms, 0 if there are none. Part `term`: the `top` terms that the group has and
    that are likelier there than in the language. Ranks go by falling value, then item by bytes. Null text, lang and source count
    as empty; rows that repeat count each; a group without terms has pairs only, a source alone in its language no pair; other
    columns are not read; an empty table gives no rows. Counts above 9 billion would leave 64 bits.
    """
    corpus = Corpus(docs, least_docs)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = source_pairs(corpus).withColumn("part", F.lit("pair")).select(*columns)
    return pairs.unionByName(strongest_terms(corpus, top).withColumn("part", F.lit("term")).select(*columns))


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, '') lang, coalesce(source, '') source, coalesce(text, '') AS body, row_number() OVER () rid FROM documents),
t AS (SELECT lang, source, rid, unnest(regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term FROM d),
c AS (SELECT lang, source, term, count(*) n FROM t GROUP BY ALL),
k AS (SELECT lang, term, count(*) n FROM t GROUP BY ALL HAVING count(DISTINCT rid) >= 3),
v AS (SELECT lang, count(*) v, sum(n)::BIGINT n FROM k GROUP BY lang),
x AS (SELECT c.lang, c.source, sum(c.n)::BIGINT n FROM c JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT o.lang, o.source, coalesce(v.v, 0) v, coalesce(v.n, 0) ln, coalesce(x.n, 0) gn FROM (SELECT DISTINCT lang, source FROM d) o LEFT JOIN v USING (lang) LEFT JOIN x USING (lang, source)),
m AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (gn + v) p, 1 + (1000000000 * (k.n + 1)) // (ln + v) q FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT val FROM m a JOIN m b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source item, coalesce(s.val, 0) val FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM m WHERE n > 0 AND p > q)
SELECT lang, source, part, item, val AS "value", (row_number() OVER (PARTITION BY lang, source, part ORDER BY val DESC, item))::INT AS "rank" FROM f
QUALIFY part = 'pair' OR "rank" <= 200
"""


def brute_force(rows: list[tuple], least_docs: int = DOCS, top: int = TOP) -> list[tuple]:
    """Rows of (text, lang, source) by the definition, for small fixtures."""
    import re

    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), lang or "", source or "") for t, lang, source in rows]
    out = []
    for lang in {d[1] for d in docs}:
        own = [d for d in docs if d[1] == lang]
        spread = Counter(t for d in own for t in set(d[0]))
        kept = [t for t, n in spread.items() if n >= least_docs]

        def chances(part: list) -> dict:
            n = Counter(t for d in part for t in d[0])
            return {t: (n[t], 1 + ONE * (n[t] + 1) // (sum(n[t] for t in kept) + len(kept))) for t in kept}

        whole, by = chances(own), {s: chances([d for d in own if d[2] == s]) for s in {d[2] for d in own}}
        far = lambda p, q: (p - q) ** 2 // q
        for s, p in by.items():
            pairs = [(sum(far(p[t][1], q[t][1]) for t in kept), o) for o, q in by.items() if o != s]
            terms = [(far(p[t][1], whole[t][1]), t) for t in kept if p[t][0] and p[t][1] > whole[t][1]]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked[: top if part == "term" else None])]
    return out

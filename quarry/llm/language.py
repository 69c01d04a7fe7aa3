"""Language identification by fusing the evidence of text, declared markup language, address suffix and host."""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Most texts of each language that the likelihoods are fitted on, hashed character n-grams, how much a page's n-grams count
#: (they overlap and depend on each other), pseudo-counts of the levels above in a host's prior.
SAMPLE, GRAMS, TEMPER, STRENGTH = 400, 1 << 14, 0.05, 5.0
SLICE = 64
HIDDEN = re.compile(r"<!--.*?-->|<(script|style|nav|header|footer|aside|template)\b.*?</\1\s*>", re.S | re.I)
TAG = re.compile(r"<[^>]*>")
DECLARED = re.compile(r"""<html\b[^>]*?\slang\s*=\s*["']?\s*([A-Za-z]{2,3})""", re.I)
HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")


def parts(html: str) -> tuple[str, str]:
    """What the first <html lang> of a page declares, wherever it is but in comments and scripts (else ""), and its visible text."""
    shown = HIDDEN.sub(" ", html)
    said = DECLARED.search(shown)
    return said[1].lower() if said else "", entities.unescape(TAG.sub(" ", shown))


def visible(html: str) -> str:
    """Text of a page without scripts, styles, navigation and tags."""
    return parts(html)[1]


def grams(text: str) -> np.ndarray:
    """Hashed n-grams (1 to 3 letters, words marked at both ends) of a text."""
    words = re.findall(r"[^\W\d_]+", text.lower())
    b = " ".join(["", *words, ""]).encode("utf-32-le", "surrogatepass")
    c = np.frombuffer(b, np.uint32).astype(np.uint64)
    if len(c) < 3:
        return np.array([], np.int64)
    one, two = c, c[:-1] * np.uint64(0x9E3779B1) + c[1:]
    three = two[:-1] * np.uint64(0x85EBCA77) + c[2:]
    mixed = np.concatenate([one * np.uint64(0xC2B2AE3D), two * np.uint64(0x27D4EB2F), three])
    return ((mixed ^ (mixed >> np.uint64(15))) % np.uint64(GRAMS)).astype(np.int64)


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities of n-grams in each, from the `sample` texts of each whose hashed id is smallest.

    The texts of each language are counted first: a hash below about twice the share that is wanted lets through a bounded number
    of texts, however many tasks there are, of which the first are taken.
    """
    from pyspark.sql import Window

    known = docs.where(docs["lang"].isNotNull() & docs["text"].isNotNull()).select(F.col("lang"), F.xxhash64("doc_id", F.lit("language")).alias("spot"), "text")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return [], np.zeros((0, GRAMS))
    share = lambda n: min(1.0, (2 * sample + 50) / n)
    bounds = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(2**63 - 1, -(2**63) + int(2**64 * share(n))))])
    few = known.where(F.col("spot") <= F.element_at(bounds, F.col("lang")))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("spot", "text"))
    chosen = few.withColumn("nth", nth).where(F.col("nth") <= sample)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[lang] = sums.get(lang, 0) + np.bincount(grams(text), minlength=GRAMS)
        for lang, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([s.tolist()], pa.list_(pa.int64()))], ["lang", "n"])

    rows = chosen.select("lang", "text").mapInArrow(counted, "lang string, n array<long>").select("lang", F.posexplode("n").alias("at", "n")).where("n > 0").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    table = np.full((len(langs), GRAMS), 0.5)
    for i, lang in enumerate(langs):
        own = rows[rows["lang"] == lang]
        table[i, own["at"].to_numpy(np.int64)] += own["n"].to_numpy(float)
    return langs, np.log(table / table.sum(axis=1, keepdims=True)) if langs else table


def identify(pages: DataFrame, docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, lang, confidence, text_lang, declared, host of each row of pages.

    Text likelihoods come from character n-grams of the visible text. What a page declares in <html lang> and its host's suffix
    weigh by how often each value goes with each language over all pages (add-one counts of text posteriors). The host's prior
    is the text posteriors of its other pages, smoothed by those of its domain (the last two labels), these by the suffix's and
    these by all pages'; all sums are grouped aggregations, combined before the shuffle. A null or textless page has text
    posteriors of equal size and goes by the rest; a null or odd url has the empty host; repeated rows count each; of languages
    with equal odds the first by name is taken. Without
    labelled docs lang is null; an empty table gives no rows. Other columns are not read.
    """
    langs, table = train(docs, sample)
    if not langs:
        return pages.select(F.col("page_id").cast("long").alias("page_id"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("text_lang"), F.lit("").alias("declared"), F.lit("").alias("host"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part, out = batch.slice(lo, SLICE), []
                for page, url, html in zip(*(part.column(i).to_pylist() for i in range(3))):
                    host, (said, text) = HOST.match(url or ""), parts(html or "")
                    host = host[1].lower().strip(".") if host else ""
                    labels = host.split(".")
                    ll = table @ np.bincount(grams(text), minlength=GRAMS) * TEMPER  # counts first: no row of a long text's length
                    p = np.exp(ll - ll.max())
                    out.append({"page_id": page, "host": host, "domain": ".".join(labels[-2:]), "suffix": labels[-1], "declared": said, "ll": (ll - ll.max()).tolist(), "p": (p / p.sum()).tolist()})
                yield pa.RecordBatch.from_pylist(out, schema=shape)

    shape = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("domain", pa.string()), ("suffix", pa.string()), ("declared", pa.string()), ("ll", pa.list_(pa.float64())), ("p", pa.list_(pa.float64()))])
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    rows = stored(slim.mapInArrow(read, "page_id long, host string, domain string, suffix string, declared string, ll array<double>, p array<double>"))
    L = len(langs)

    def sums(by: list[str], name: str) -> DataFrame:
        return stored(rows.groupBy(*by).agg(F.array(*[F.sum(F.col("p")[i]) for i in range(L)]).alias(name)))

    hosts, domains, suffixes, said = sums(["host", "domain", "suffix"], "h"), sums(["domain", "suffix"], "d"), sums(["suffix"], "s"), sums(["declared"], "c")
    everything = rows.agg(*[F.sum(F.col("p")[i]) for i in range(L)]).first()
    total = [float(x or 0) for x in everything]
    base = F.array(*[F.lit((x + 1) / (sum(total) + L)) for x in total])
    alls = F.array(*[F.lit(x) for x in total])

    def smooth(counts, above):
        n = F.aggregate(counts, F.lit(0.0), lambda t, x: t + x)
        return F.zip_with(counts, above, lambda x, q: (x + STRENGTH * q) / (n + STRENGTH))

    # a page's own posterior is taken out of the sums that it is judged by
    less = lambda counts: F.zip_with(counts, "p", lambda x, y: F.greatest(F.lit(0.0), x - y))
    table_ = hosts.join(domains, ["domain", "suffix"]).join(suffixes, "suffix")
    joined = rows.join(table_, ["host", "domain", "suffix"]).join(said, "declared")
    joined = joined.withColumn("prior", smooth(less(F.col("h")), smooth(less(F.col("d")), smooth(less(F.col("s")), base))))
    weigh = lambda counts: F.zip_with(F.transform(less(counts), lambda x: x + 1), alls, lambda x, t: F.log(x / (t + L)))
    joined = joined.withColumn("odds", F.zip_with(F.zip_with(F.zip_with("ll", F.transform("prior", lambda x: F.log(x)), lambda x, y: x + y), F.when(F.col("declared") == "", F.transform(alls, lambda x: F.lit(0.0))).otherwise(weigh(F.col("c"))), lambda x, y: x + y), weigh(F.col("s")), lambda x, y: x + y))
    best = F.array_max("odds")
    share = F.aggregate(F.transform("odds", lambda x: F.exp(x - best)), F.lit(0.0), lambda t, x: t + x)
    names = F.array(*[F.lit(x) for x in langs])
    pick = lambda col: F.element_at(names, F.array_position(col, F.array_max(col)).cast("int"))
    return joined.select("page_id", pick(F.col("odds")).alias("lang"), (1 / share).alias("confidence"), pick(F.col("ll")).alias("text_lang"), "declared", "host")

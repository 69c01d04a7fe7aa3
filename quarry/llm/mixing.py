"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored, text_of

#: Rows that a key range of a source should hold, and fewest ranges; only the range that holds a source's cut is sorted.
BIN_ROWS, BINS = 20_000, 1024
WEIGHTS = (3, 1, 2)


def quality(text: Column) -> Column:
    """Weight of a document, 0.1 to 1: the share of its characters that are letters or spaces."""
    share = F.length(F.regexp_replace(text, r"[^\p{L} ]", "")) / F.greatest(F.lit(1), F.length(text))
    return F.greatest(F.lit(0.1), share)


def sized(docs: DataFrame, seed: str, weight: Column | None) -> DataFrame:
    """docs with w_size, w_source and w_key: the exponential key -ln(u) / weight, u drawn from a digest of seed and doc_id."""
    text = text_of(docs)
    number = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(docs["doc_id"].cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double")
    source = F.when(docs["source"].isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), docs["source"]))
    key = -F.log((number + 0.5) / float(2**52)) / (quality(text) if weight is None else weight)
    return docs.withColumns({"w_size": F.regexp_count(text, F.lit(WORD)).cast("long"), "w_source": source, "w_key": key})


def plan(slim: DataFrame, weights: tuple, share: float, most: float, bins: int | None) -> DataFrame:
    """A row for each source: its size, its target, its complete epochs, and where in key order the fractional epoch ends.

    slim: doc_id, w_size, w_source, w_key. The cut is found in two steps: sums over `bins` key ranges (None: as many as keep a
    range at about BIN_ROWS rows), then the rows of the one range that holds it.
    """
    bins = bins or max(BINS, -(-slim.count() // BIN_ROWS))
    ranged = slim.withColumn("bin", F.floor(F.lit(bins) * (1 - F.exp(-F.col("w_key")))).cast("int"))
    sums = stored(ranged.groupBy("w_source", "bin").agg(F.sum("w_size").alias("n")))
    sources = sums.groupBy("w_source").agg(F.sum("n").alias("source_size"))
    # "n" (null) sorts before "s..." and must come last
    nth = F.row_number().over(Window.orderBy(F.col("w_source") == "n", "w_source")) - 1
    sources = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int")))
    everything = Window.partitionBy()
    sources = sources.withColumns({"all_size": F.sum("source_size").over(everything), "all_weight": F.sum("weight").over(everything), "most": F.col("source_size") * most})
    before = Window.orderBy(F.col("most") / F.col("weight"), "w_source").rowsBetween(Window.unboundedPreceding, -1)
    rate = (share * F.col("all_size") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    sources = sources.withColumn("rate", rate).withColumn("full", F.col("most") / F.col("weight") <= F.col("rate"))
    # the rate rises while full sources are left out, and falls after: it is right at the first that is not full
    level = F.max(F.when(~F.col("full"), F.col("rate"))).over(everything)
    sources = sources.withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * level))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sources = sources.withColumn("epochs", epochs).withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    sources = stored(sources.select("w_source", "source_size", "target", "epochs", "rest"))
    ahead = Window.partitionBy("w_source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    cut = sums.withColumn("bin_start", F.coalesce(F.sum("n").over(ahead), F.lit(0))).join(sources, "w_source").where((F.col("bin_start") <= F.col("rest")) & (F.col("rest") < F.col("bin_start") + F.col("n")))
    cut = stored(cut.select("w_source", "bin", "bin_start", "rest"))
    alike = ranged.join(cut, ["w_source", "bin"]).groupBy("w_source", "w_key", "doc_id", "bin_start", "rest").agg(F.sum("w_size").alias("tie_size"))
    inner = Window.partitionBy("w_source").orderBy("w_key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    last = alike.withColumn("start", F.col("bin_start") + F.coalesce(F.sum("tie_size").over(inner), F.lit(0)))
    last = last.where((F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("start") + F.col("tie_size")))
    last = last.select("w_source", F.col("w_key").alias("cut_key"), F.col("doc_id").alias("cut_id"), ((F.col("rest") - F.col("start")) / F.col("tie_size")).alias("cut_share"))
    return stored(sources.join(last, "w_source", "left"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "mix", weight: Column | None = None, bins: int | None = None) -> DataFrame:
    """docs with size, source_size, target, taken and whole_epochs added.

    size is the number of words (a null text has none). Sources, by code point with null last, weigh `weights`, repeating; they
    share `share` times all words by weight, none getting more than `most` times its own, the excess going to the others by
    weight. A source first takes all its documents as often as its target holds it whole; the rest goes to the documents with
    the smallest keys, the last of them in part, so that a source takes its target rounded to a word. Keys depend on seed,
    doc_id and quality weight (`weight`, a column, or the default) alone, so reruns agree; rows with equal key and id share the
    cut evenly (rounded down). Columns of docs with these names are replaced; others stay. An empty table gives no rows.
    """
    docs = docs.drop("size", "source_size", "target", "taken", "whole_epochs", "w_size", "w_source", "w_key")
    rows = sized(docs, seed, weight)
    return _taken(rows, plan(stored(rows.select("doc_id", "w_size", "w_source", "w_key")), weights, share, most, bins))


def _taken(rows: DataFrame, sources: DataFrame) -> DataFrame:
    after = (F.col("w_key") > F.col("cut_key")) | ((F.col("w_key") == F.col("cut_key")) & F.coalesce(F.col("doc_id") > F.col("cut_id"), F.col("doc_id").isNotNull() & F.col("cut_id").isNull(), F.lit(False)))
    at = (F.col("w_key") == F.col("cut_key")) & F.col("doc_id").eqNullSafe(F.col("cut_id"))
    part = F.when(F.col("cut_key").isNull(), F.lit(0)).when(at, F.floor(F.col("w_size") * F.col("cut_share") + 1e-6)).when(after, F.lit(0)).otherwise(F.col("w_size"))
    out = rows.join(sources, "w_source").withColumn("taken", (F.col("epochs") * F.col("w_size") + part).cast("long"))
    return out.withColumnRenamed("w_size", "size").withColumnRenamed("epochs", "whole_epochs").drop("w_source", "w_key", "rest", "cut_key", "cut_id", "cut_share")


def mix_sizes(docs: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "mix", weight: Column | None = None, bins: int | None = None) -> DataFrame:
    """As mix(), without the columns of docs but doc_id: the texts are read once."""
    slim = stored(sized(docs, seed, weight).select("doc_id", "w_size", "w_source", "w_key"))
    return _taken(slim, plan(slim, weights, share, most, bins))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         -ln((('0x' || substr(md5('mix:' || doc_id::VARCHAR), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)
           / greatest(0.1, length(regexp_replace(coalesce(text, ''), '[^\p{L} ]', '', 'g')) / greatest(1, length(coalesce(text, '')))) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM d GROUP BY source),
f AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS rate
      FROM s WINDOW b AS (ORDER BY 2.0 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN 2.0 * source_size / w <= rate THEN 2.0 * source_size
        ELSE w * max(CASE WHEN 2.0 * source_size / w > rate THEN rate END) OVER () END AS target FROM f),
e AS (SELECT *, floor(target / source_size)::BIGINT AS epochs FROM t),
p AS (SELECT d.*, e.source_size, e.target, e.epochs, round(target - epochs * source_size)::BIGINT AS rest,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size::BIGINT AS size, source_size, target::DOUBLE AS target,
       (epochs * size + greatest(0, least(size, rest - start)))::BIGINT AS taken FROM p
"""

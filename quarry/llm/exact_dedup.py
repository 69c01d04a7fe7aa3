"""Exact deduplication by deterministic block naming, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, stored, text_of

BLOCK = 4096


def normalised(text: Column) -> Column:
    """The form in which texts are compared: each run of ASCII white space is one space."""
    return F.regexp_replace(text, SPACES, " ")


def _named(distinct: DataFrame, by: list[str]) -> DataFrame:
    """An integer name for each row: hash partitions of the distinct rows, each sorted, numbered in that order. The same rows get
    the same names when a task is run again."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def _blocks(docs: DataFrame, block: int) -> DataFrame:
    """rid, n_bytes, pos, block, digest of each block of each text; doc_id and text_sha256 with a text's first."""
    text = normalised(text_of(docs))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), F.sha2(text, 256).alias("text_sha256"), text.cast("binary").alias("bytes"))
    rows = rows.withColumn("n_bytes", F.octet_length("bytes").cast("long"))
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.col("n_bytes") - 1) / block).cast("int")), lambda i: F.substring(F.col("bytes"), i * block + 1, F.lit(block)))
    first = F.col("pos") == 0
    blocks = rows.select("rid", "doc_id", "text_sha256", "n_bytes", F.posexplode(parts).alias("pos", "block"))
    return blocks.select("rid", "n_bytes", "pos", F.when(first, F.col("doc_id")).alias("doc_id"), F.when(first, F.col("text_sha256")).alias("text_sha256"), "block", F.unhex(F.sha2("block", 256)).alias("digest"))


def identities(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """rid, doc_id, text_sha256, n_bytes, name: rows have equal (n_bytes, name) exactly if their normalised texts are equal.

    Each text is cut into blocks of `block` bytes. The distinct blocks, compared by their bytes, get integer names in sorted
    order; then adjacent names are paired and the distinct pairs named, level by level, until each text has one name. The text
    crosses the network once, for the distinct blocks; names come back by the blocks' digests, and by their bytes for digests
    that two different blocks share. Rows are numbered once, in a table of digests; it and each level lie in the shared folder.
    """
    first = F.col("pos") == 0
    blocks = _blocks(docs, block)
    numbered = stored(blocks.drop("block"))
    names = stored(_named(blocks.select("block", "digest").distinct(), ["block"]).select("digest", "name"))
    shared = names.groupBy("digest").agg(F.count("*").alias("n"), F.min("name").alias("name"))
    level = numbered.join(names, "digest")
    if not shared.where("n > 1").isEmpty():  # different blocks with one digest: those go by their bytes
        clash = shared.where("n > 1").select("digest")
        blocks = stored(blocks)  # numbered anew, with their bytes
        exact = stored(_named(blocks.join(clash, "digest", "left_semi").select("block").distinct(), ["block"]).withColumn("name", -1 - F.col("name")))
        level = blocks.drop("block").join(names.join(clash, "digest", "left_anti"), "digest").unionByName(blocks.join(clash, "digest", "left_semi").join(exact, "block").select(*level.columns))
    level = stored(level.drop("digest"))
    heads = level.where(first).select("rid", "doc_id", "text_sha256", "n_bytes", "name")
    current, done = level.where(F.col("n_bytes") > block).select("rid", "n_bytes", "pos", "name"), None
    most, width = level.agg(F.max("n_bytes")).first()[0] or 0, block
    while width < most:
        even = F.col("pos") % 2 == 0
        pairs = current.groupBy("rid", "n_bytes", F.floor(F.col("pos") / 2).cast("int").alias("at")).agg(
            F.max(F.when(even, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1).cast("long")).alias("right")
        )
        pairs = stored(pairs)
        names = stored(_named(pairs.select("left", "right").distinct(), ["left", "right"]))
        current = stored(pairs.join(names, ["left", "right"]).select("rid", "n_bytes", F.col("at").alias("pos"), "name"))
        width *= 2
        ended = current.where(F.col("n_bytes") <= width).select("rid", F.col("name").alias("last"))
        done = ended if done is None else done.unionByName(ended)
        current = current.where(F.col("n_bytes") > width)
    if done is None:
        return heads
    long = heads.where(F.col("n_bytes") > block).join(done, "rid").select("rid", "doc_id", "text_sha256", "n_bytes", F.col("last").alias("name"))
    return heads.where(F.col("n_bytes") <= block).unionByName(long)


def exact_dedup(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row for each row of docs, by whole texts.

    A null text counts as empty, and all empty texts are one group. Of equal texts the row with the smallest doc_id stays, a
    null doc_id counting as the largest, and of repeated rows with that doc_id just one. An empty table gives no rows.
    Other columns are not read.
    """
    rows = stored(identities(docs, block))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")
    groups = stored(rows.groupBy("n_bytes", "name").agg(F.min(order).alias("best"), F.count("*").alias("size")).where("size > 1"))
    groups = groups.select("n_bytes", "name", F.col("best.doc_id").alias("best_id"), F.col("best.rid").alias("best_rid"), "size")
    grouped = F.col("size").isNotNull()
    return rows.join(groups, ["n_bytes", "name"], "left").select(
        "doc_id",
        F.when(grouped, F.col("best_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        F.when(grouped, F.col("best_rid") == F.col("rid")).otherwise(F.lit(True)).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of docs, all columns whatever they are named, that exact_dedup() keeps; of repeated rows one."""
    key = "k_text"
    while key in docs.columns:
        key += "_"
    found = stored(exact_dedup(docs, block))
    kept = found.where("kept").select(F.col("doc_id").alias("k_id"), F.col("text_sha256").alias("k_sha"))
    keyed = docs.withColumn(key, F.sha2(normalised(text_of(docs)), 256))
    out = keyed.join(kept, keyed["doc_id"].eqNullSafe(kept["k_id"]) & (keyed[key] == kept["k_sha"]), "left_semi")
    if not found.where(~F.col("kept") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).isEmpty():
        out = out.dropDuplicates(["doc_id", key])
    return out.drop(key)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""

"""A document pipeline of five stages, each by one of the training-data operators.

Stages take (spark, docs, sf_dir). Each is written as Parquet and read again as the next one's docs; all but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import exact_dedup
from quarry.llm.common import DOCUMENT_COLUMNS, stored, table
from quarry.llm.jaccard_join import one_of_each
from quarry.llm.mixing import mix
from quarry.llm.quality import classify
from quarry.llm.sentencepiece_codec import encode


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Null, empty and wordless texts go; repeated rows and null ids stay as they are."""
    return classify(docs).where("accepted").select(*DOCUMENT_COLUMNS)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the smallest doc_id, null ids last; one row where rows repeat. Null counts as empty."""
    return exact_dedup.without_copies(docs).select(*DOCUMENT_COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: the smallest doc_id, null ids last. Rows are known by id and text, so a
    text that shares its id with a near copy stays. Texts without words stay."""
    return one_of_each(docs.select(*DOCUMENT_COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time a document is taken whole, and a row with the words that are taken of one taken in part.
    Wordless texts are in no mix; rows of equal id and key share a cut evenly."""
    rows = mix(docs)
    times = F.floor(F.col("taken") / F.greatest(F.lit(1), F.col("size"))).cast("int")
    part = F.col("taken") - times * F.col("size")
    whole = rows.select(*DOCUMENT_COLUMNS, F.explode(F.when(times > 0, F.sequence(F.lit(1), times))).alias("nth"))
    words = F.slice(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), 0), F.lit(1), part.cast("int"))
    some = rows.where(part > 0).withColumn("text", F.array_join(words, "")).withColumn("n_chars", F.length("text").cast("long"))
    return whole.select(*DOCUMENT_COLUMNS).unionByName(some.select(*DOCUMENT_COLUMNS))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece_ids, n_pieces of each row of the mix, repeated rows and null ids included; a null or empty text has no pieces."""
    return encode(docs).select("doc_id", "piece_ids", F.size("piece_ids").cast("long").alias("n_pieces"))


STAGES = [("quality classifier", good_documents), ("exact dedup", without_copies), ("n-gram Jaccard join", without_near_copies), ("mixing sources to target weights", mixed), ("SentencePiece encoding", encoded)]
#: A trained classifier and a tokenizer can't be written as SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*DOCUMENT_COLUMNS)
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs

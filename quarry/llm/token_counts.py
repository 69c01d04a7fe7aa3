"""Token counts of whole texts by overlap resynchronisation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import default_model, vocabulary

#: Rows of a batch that are in work at a time.
SLICE = 256


def token_counts(docs: DataFrame, model: bytes | None = None, limit: int = 4096, window: int = 32_768, overlap: int = 64) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row's whole text, as the library counts them.

    Texts longer than window characters are encoded in overlapping windows that are spliced where both give the same token
    (see Vocabulary.count), so a task's memory is bounded by a window beside the text. A null or empty text has 0 bytes and 0
    tokens; repeated rows and null ids give a row each; other columns are not read. An empty table gives no rows.
    """
    proto = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(proto)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                counts = words.count_many(part.column(2).to_pylist(), window, overlap)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(docs["text"], F.lit(""))
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)

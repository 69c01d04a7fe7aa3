"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: ASCII white space only.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a batch that goes to Python, where the session leaves Spark's own 64 MB: with long texts each running task would
#: otherwise hold several times that outside the heap, in the executor and in its worker.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m")


def small_batches(spark: SparkSession) -> None:
    if spark.conf.get(BATCH[0], BATCH[1]) in (BATCH[1], "64m", "64MB", "67108864"):
        spark.conf.set(BATCH[0], BATCH[2])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and there is one machine (local tests)."""
    small_batches(spark)
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"file://{os.path.join(tempfile.gettempdir(), f'quarry-{spark.sparkContext.applicationId}')}"
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    return where


def stored(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """df written once as a table in the shared folder and read back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files behind a frame made by stored(), once nothing reads it any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def text_of(df: DataFrame, name: str = "text"):
    return F.coalesce(df[name].cast("string"), F.lit(""))

"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where it is unset and there is one machine, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"file://{os.path.join(tempfile.gettempdir(), f'quarry-{spark.sparkContext.applicationId}')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def materialised(df: DataFrame, *partition_by: str) -> DataFrame:
    """df written once and read back, so that what reads it several times doesn't compute it as often, and filters and columns
    reach the files."""
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, *keys: str) -> DataFrame:
    """df written once, dealt by keys into a bucket a shuffle partition: a join on these keys shuffles its other side only, however
    often there is one."""
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"quarry_{uuid.uuid4().hex}"
    df.repartition(n, *keys).write.bucketBy(n, *keys).option("path", f"{shared_dir(spark)}/tables/{name}").saveAsTable(name)
    return spark.table(name)

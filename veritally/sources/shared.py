"""Tables written between the rounds of an iterative operator, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, on a local master only, a folder of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        at = f"file://{tempfile.mkdtemp(prefix='veritally-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def cut(df: DataFrame, name: str = "round") -> DataFrame:
    """df written as Parquet and read again: its lineage ends there, and lost executors cost no earlier round."""
    spark = df.sparkSession
    path = f"{folder(spark)}/veritally/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def wide(df: DataFrame) -> DataFrame:
    """df joined by sorting, never sent whole to every task: a stored table that grows with the input may be small on disk only, for its texts are alike."""
    return df.hint("merge")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt over all cores (rows of equal `by` together): a file may be one row group, and small exchanges are joined to few tasks.

    For work that costs much more a row than its bytes tell.
    """
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)

"""Shared storage, lineage cuts and size-checked broadcasts for the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it was counted and has at most this many (narrow) rows.
BROADCAST_ROWS = 50_000

#: One word: a run of anything but the space and the ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/lumenfold-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage by a Parquet table in the shared folder, so that lost executors cost a reread only.

    The folder of an application may be deleted when the application has ended.
    """
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a materialized side for broadcast if its counted size is within the bound; else leaves it to a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def empty_if_null(name: str):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))

"""Lineage cuts in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new path under spark.checkpoint.dir (in local mode under a folder of our own, if unset)."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        top = "file:///tmp/checkpoints"
    return f"{top.rstrip('/')}/lumenfold-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes the rows to a shared folder and reads them."""
    path = shared_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that ``materialize`` wrote, once nothing reads them."""
    sc = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if f"/lumenfold-{sc.applicationId}/" not in folder:
            raise ValueError(f"not a table of this application's own: {folder}")
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


#: A side is broadcast only if it was counted and has at most this many narrow rows.
BROADCAST_ROWS = 50_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a materialized side for broadcast if its counted rows are within the bound; else leaves it to a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df

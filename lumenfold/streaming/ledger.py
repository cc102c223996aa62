"""An extension: the engine's stateless scoring and its ledgers over streams of files.

The batch operators have no streaming counterpart to match; these are the parts that make sense of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenfold.functions import text as TX
from lumenfold.operators import proximity as P


def document_stream(spark: SparkSession, path: str, *, files: int = 100) -> DataFrame:
    """New Parquet files of (doc_id, text, arrived), so many a batch."""
    return spark.readStream.schema("doc_id bigint, text string, arrived timestamp").option("maxFilesPerTrigger", files).parquet(path)


def distinct_texts(docs: DataFrame, delay: str = "1 day") -> DataFrame:
    """Drops texts seen within the watermark; state is bounded by the delay."""
    return docs.withWatermark("arrived", delay).withColumn("content_hash", F.sha2(F.coalesce("text", F.lit("")), 256)).dropDuplicatesWithinWatermark(["content_hash"])


def score_stream(docs: DataFrame, vocabularies: tuple[DataFrame, DataFrame, DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Appends raw scores of each batch to ``out`` until the input is exhausted; batches are written by their
    number, so one that is repeated after a failure replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        tokens = batch.withColumn("tokens", TX.scorer_tokens(F.col("text")))
        P.raw_scores(tokens, "tokens", *vocabularies).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(docs: DataFrame, window: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Documents and words of each window of arrival; rows later than the delay are dropped by the watermark."""
    return docs.withWatermark("arrived", delay).groupBy(F.window("arrived", window)).agg(F.count("*").alias("n"), F.sum(TX.word_count(F.col("text"))).alias("words"))

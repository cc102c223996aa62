"""A corpus from documents to token ids: quality rules, line dedup, near-dedup, mixing, encoding.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of documents. Each is written
as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenfold.llm.bpe import bpe_round_trip
from lumenfold.llm.common import materialize
from lumenfold.llm.line_dedup import drop_boilerplate
from lumenfold.llm.mixing import take
from lumenfold.llm.quality import keep_good
from lumenfold.llm.simhash import drop_near_duplicates


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; cutoffs come from the labels of documents still there."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without cross-site boilerplate lines; texts of nothing else stay whole."""
    return drop_boilerplate(docs, counts=False)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes of a document."""
    return take(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and the digests of their round trip."""
    import public_tokenizers as P

    return bpe_round_trip(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, keep=["source", "lang"], ids=True)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", lines_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("mixing sources", mixing_stage),
    ("byte-level bpe", encoding_stage),
]

#: Fingerprint components and balanced draws have no SQL form; tests hold the rows of run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Custody of files: digests rolled up to one root, frozen and verified, and plans of what may be deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators.records import ContractError

#: Names fall into 16^4 buckets by their digest; the root is taken over at most so many bucket digests.
PREFIX = 4
STATES = ["matched", "changed", "missing", "added"]


def pins(spark: SparkSession, folder: str, *, pattern: str = "*") -> DataFrame:
    """(path, bytes, digest): every file under the folder, hidden ones apart, its path from there on. A file is a row
    of one task, so files have at most 2 GB. The reader has no rows for files of no bytes: one that was emptied is missing. An empty
    folder has no rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    top = top.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(top).toUri().getPath().rstrip("/")
    inside = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:(//[^/]*)?", ""), r"^/*", "/")
    return files.select(F.substr(inside, F.lit(len(top) + 2)).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("digest"))


def bucket_digests(rows: DataFrame, name: str, digest: Column) -> DataFrame:
    """(bucket, n, digest): SHA-256 over the lines "digest name" of each bucket in order of names, then digests, equal
    rows repeated. Null names or digests count as empty."""
    line = rows.select(F.coalesce(F.col(name).cast("string"), F.lit("")).alias("__n"), F.coalesce(digest, F.lit("")).alias("__d"))
    both = F.sort_array(F.collect_list(F.struct("__n", "__d")))
    text = F.array_join(F.transform(both, lambda x: F.concat(x["__d"], F.lit(" "), x["__n"])), "\n")
    return line.groupBy(F.substr(F.sha2("__n", 256), F.lit(1), F.lit(PREFIX)).alias("bucket")).agg(F.count("*").alias("n"), F.sha2(text, 256).alias("digest"))


def root_digest(rows: DataFrame, name: str, digest: Column) -> DataFrame:
    """(n, buckets, root): one row, whatever the partitions; without rows the root is the digest of no lines."""
    found = F.sort_array(F.collect_list(F.struct("bucket", "digest")))
    text = F.array_join(F.transform(found, lambda x: F.concat(x["digest"], F.lit(" "), x["bucket"])), "\n")
    return bucket_digests(rows, name, digest).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("buckets"), F.sha2(text, 256).alias("root"))


def verified(frozen: DataFrame, found: DataFrame, *, name: str = "path", digest: str = "digest") -> DataFrame:
    """(name, frozen, found, state): matched, changed, missing or added, one row a name. Names are unique and not null on
    either side, else ContractError."""
    for side, df in (("frozen", frozen), ("found", found)):
        if df.groupBy(F.col(name).alias("__n")).agg(F.count("*").alias("__c")).where("__c > 1 or __n is null").limit(1).count():
            raise ContractError(f"{side}: names are null or repeated")
    a, b = frozen.select(F.col(name).alias("__a"), F.col(digest).alias("frozen")), found.select(F.col(name).alias("__b"), F.col(digest).alias("found"))
    state = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "added").when(F.col("frozen").eqNullSafe(F.col("found")), "matched").otherwise("changed")
    return a.join(b, F.col("__a") == F.col("__b"), "full_outer").select(F.coalesce("__a", "__b").alias(name), "frozen", "found", state.alias("state"))


def retention_plan(rows: DataFrame, paths: dict[str, Column | None], keep: Column) -> DataFrame:
    """(path, rows, kept_rows, digests, action): every path that a row names in any of the columns, once.

    ``paths`` maps a column of paths to its digest (None: unknown), ``keep`` is the condition of rows that stay; null
    is no. A path that a kept row names in any column is retained; one with several digests is held for review; others
    may be deleted. Null and blank paths name nothing. Counts are aggregated before the shuffle, so a
    path that most rows name is one row of each task.
    """
    named = F.array_distinct(F.array(*[F.struct(F.nullif(F.trim(F.col(c)), F.lit("")).alias("path"), (F.lit(None).cast("string") if d is None else d).alias("digest")) for c, d in paths.items()]))
    one = rows.select(F.coalesce(keep, F.lit(False)).alias("__keep"), named.alias("__p")).withColumn("__paths", F.array_distinct(F.transform("__p", lambda x: x["path"])))
    # a row counts once for a path, whichever columns name it; all its digests of the path go along
    each = one.select("__keep", "__p", F.explode(F.array_compact("__paths")).alias("path"))
    own = F.transform(F.filter("__p", lambda x: x["path"] == F.col("path")), lambda x: x["digest"])
    per = each.select("path", "__keep", F.array_min(own).alias("__lo"), F.array_max(own).alias("__hi"))
    sums = per.groupBy("path").agg(F.count("*").alias("rows"), F.count_if("__keep").alias("kept_rows"), F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"))
    differ = F.coalesce(F.col("__lo") != F.col("__hi"), F.lit(False))
    action = F.when(F.col("kept_rows") > 0, "retain").when(differ, "review").otherwise("delete")
    return sums.select("path", "rows", "kept_rows", F.when(~differ, F.col("__lo")).alias("digest"), action.alias("action"))

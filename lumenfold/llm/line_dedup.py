"""Cross-site boilerplate lines by distinct-site spread, in DataFrame functions only.

Every line's sites go into a HyperLogLog sketch that merges by aggregation. Estimates clearly at either side
of the threshold decide; lines near it get an exact count of distinct sites. Lines of enough sites leave the
documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, empty_if_null, materialize, small

#: Distinct sites that make a line boilerplate.
SITES = 10
LG_K = 12
#: Standard errors of the sketch (1.04 / sqrt(2^LG_K) each) around the threshold that are counted exactly.
ERRORS = 6

BLANKS = " \t\n\x0b\f\r"


def _key(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def _row(id_col: str, text_col: str) -> Column:
    """Rows of equal id and text share their lines; null and repeated ids are no group of their own."""
    return F.xxhash64(id_col, text_col)


def line_table(docs: DataFrame, *, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(id, site, h) for each distinct line with a word of a row; id is a hash of its id and text, h the 64-bit
    hash of the trimmed line."""
    lines = docs.select(_row(id_col, text_col).alias("id"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"), F.explode(F.array_distinct(F.transform(F.filter(F.split(empty_if_null(text_col), "\n"), lambda x: x.rlike(WORD)), lambda x: F.xxhash64(_key(x))))).alias("h"))
    return materialize(lines, "lines")


def boilerplate(lines: DataFrame, *, sites: int = SITES) -> DataFrame:
    """(h) of the lines on at least so many distinct sites."""
    spread = lines.groupBy("h").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch")).select("h", F.hll_sketch_estimate("sketch").alias("n"))
    band = ERRORS * 1.04 / 2 ** (LG_K / 2) * sites + 1
    wide = materialize(spread.where(F.col("n") > sites - band), "spread")
    near = wide.where(F.col("n") < sites + band).select("h")
    exact = lines.join(small(near), "h", "left_semi").select("h", "site").distinct().groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= sites).select("h")
    return materialize(wide.where(F.col("n") >= sites + band).select("h").unionByName(exact), "boilerplate")


def drop_boilerplate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", sites: int = SITES, counts: bool = True) -> DataFrame:
    """``docs`` with cleaned texts and, with ``counts``, two more columns, __lines and __removed (counts of lines with
    a word); columns of ``docs`` of these names are then left out.

    Lines are compared without the white space at their ends; lines without a word are never boilerplate. A
    null text stays null, a null site counts as the site ''. All rows stay, also repeated ones, each cleaned for
    itself (what is boilerplate is so everywhere). Only a text of which every line with a word is boilerplate
    stays whole: it is a copy as a whole, which near-dedup is for. An empty table gives no rows.
    """
    if counts:
        docs = docs.drop("__lines", "__removed")
    lines = line_table(docs, id_col=id_col, text_col=text_col, site_col=site_col)
    found = lines.join(small(boilerplate(lines, sites=sites)), "h", "left_semi").groupBy(F.col("id").alias("__id")).agg(F.collect_set("h").alias("__found"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), _row(id_col, text_col).alias("__key"), F.split(empty_if_null(text_col), "\n").alias("__all"))
    joined = packed.join(found.hint("merge"), F.col("__key") == F.col("__id"), "left")
    kept = F.when(F.col("__found").isNull(), F.col("__all")).otherwise(F.filter("__all", lambda x: ~F.coalesce(F.array_contains(F.col("__found"), F.xxhash64(_key(x))), F.lit(False)) | ~x.rlike(WORD)))
    joined = joined.withColumn("__kept", kept)
    words = lambda c: F.size(F.filter(c, lambda x: x.rlike(WORD)))
    joined = joined.withColumn("__clean", F.when(words("__kept") > 0, F.col("__kept")).otherwise(F.col("__all")))
    text = F.when(F.col(f"__row.`{text_col}`").isNull(), F.lit(None)).otherwise(F.array_join("__clean", "\n"))
    own = [words("__all").cast("bigint").alias("__lines"), (F.size("__all") - F.size("__clean")).cast("bigint").alias("__removed")] if counts else []
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"__row.`{c}`").alias(c) for c in docs.columns], *own)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """What line dedup leaves of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return drop_boilerplate(docs).select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def lines_sql(docs: str = "documents", sites: int = SITES) -> str:
    """CTEs in DuckDB's SQL that end in ``cleaned``: the rows of ``docs`` with their cleaned text."""
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return rf"""
    split AS (SELECT *, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS l FROM {docs}),
    each_line AS (SELECT rid, coalesce(source, '') AS site, unnest(l) AS line, generate_subscripts(l, 1) AS p FROM split),
    marked AS (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS w, trim(line, {blanks}) AS key FROM each_line),
    wide AS (SELECT key FROM marked WHERE w GROUP BY key HAVING count(DISTINCT site) >= {sites}),
    flagged AS (SELECT marked.*, w AND key IN (SELECT key FROM wide) AS gone FROM marked),
    totals AS (SELECT rid, count(*) FILTER (w) AS n_lines, count(*) FILTER (gone) AS n_gone,
        coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '') AS rest FROM flagged GROUP BY rid),
    cleaned AS (SELECT split.* EXCLUDE (text, l), n_lines::BIGINT AS n_lines, CASE WHEN n_gone < n_lines THEN n_gone ELSE 0 END::BIGINT AS n_removed,
        CASE WHEN text IS NULL THEN NULL WHEN n_gone < n_lines THEN rest ELSE text END AS text FROM split JOIN totals USING (rid))"""


OP10_SQL = f"WITH {lines_sql()} SELECT doc_id, n_lines, n_removed, length(text)::BIGINT AS n_chars, sha256(text) AS text_sha256 FROM cleaned"

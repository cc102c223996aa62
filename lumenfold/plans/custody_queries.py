"""Queries over the documents as files in custody: digests, checks against them, and what may be deleted."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import custody as C
from lumenfold.plans.table_queries import table


def corpus_root(spark, sf_dir):
    """One digest of all texts by their ids."""
    return C.root_digest(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", F.sha2("text", 256))


ROOT = f"""WITH l AS (SELECT doc_id::VARCHAR AS n, coalesce(sha256(text), '') AS d FROM documents), b AS (SELECT left(sha256(n), {C.PREFIX}) AS bucket, count(*) AS n, sha256(string_agg(d || ' ' || n, chr(10) ORDER BY n, d)) AS digest FROM l GROUP BY 1)
SELECT coalesce(sum(n), 0)::BIGINT AS n, count(*) AS buckets, sha256(coalesce(string_agg(digest || ' ' || bucket, chr(10) ORDER BY bucket, digest), '')) AS root FROM b"""


def cleaned_texts(spark, sf_dir):
    """Texts as they were frozen against those of at least 200 code points with single spaces: what cleaning changed or lost."""
    docs = table(spark, sf_dir, "documents")
    found = docs.where("n_chars >= 200").select("doc_id", F.sha2(F.regexp_replace("text", "[ \t\r\n]+", " "), 256).alias("digest"))
    out = C.verified(docs.select("doc_id", F.sha2("text", 256).alias("digest")), found, name="doc_id")
    return out.select("doc_id", F.substr("frozen", F.lit(1), F.lit(16)).alias("frozen"), F.substr("found", F.lit(1), F.lit(16)).alias("found"), "state")


CLEANED = r"""WITH f AS (SELECT doc_id, sha256(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')) AS found FROM documents WHERE n_chars >= 200)
SELECT d.doc_id, left(sha256(text), 16) AS frozen, left(found, 16) AS found, CASE WHEN f.doc_id IS NULL THEN 'missing' WHEN sha256(text) IS NOT DISTINCT FROM found THEN 'matched' ELSE 'changed' END AS state FROM documents d LEFT JOIN f USING (doc_id)"""


def retained_paths(spark, sf_dir):
    """Files that documents name: one for each text, one for each opening of 40 code points, one a source; long English
    documents stay, and so does every file that one of them names."""
    docs = table(spark, sf_dir, "documents").select("text", "source", "lang", "n_chars")
    docs = docs.select("*", F.sha2("text", 256).alias("sha"), F.concat(F.lit("head/"), F.md5(F.substr("text", F.lit(1), F.lit(40)))).alias("head"), F.concat(F.lit("source/"), "source", "lang").alias("bundle"))
    docs = docs.withColumn("raw", F.concat(F.lit("raw/"), F.substr("sha", F.lit(1), F.lit(16))))
    return C.retention_plan(docs, {"raw": F.col("sha"), "head": F.col("sha"), "bundle": None}, (F.col("lang") == "en") & (F.col("n_chars") >= 2000))


RETAINED = """WITH d AS (SELECT coalesce(lang = 'en' AND n_chars >= 2000, false) AS keep, sha256(text) AS sha, text, source, lang FROM documents),
p AS (SELECT 'raw/' || left(sha, 16) AS path, sha AS digest, keep FROM d UNION ALL SELECT 'head/' || md5(left(text, 40)), sha, keep FROM d UNION ALL SELECT 'source/' || source || lang, NULL, keep FROM d)
SELECT path, count(*) AS rows, count(*) FILTER (keep) AS kept_rows, CASE WHEN count(DISTINCT digest) = 1 THEN min(digest) END AS digest, CASE WHEN bool_or(keep) THEN 'retain' WHEN count(DISTINCT digest) > 1 THEN 'review' ELSE 'delete' END AS action FROM p WHERE path IS NOT NULL GROUP BY path"""

QUERIES = {"corpus_root": corpus_root, "cleaned_texts": cleaned_texts, "retained_paths": retained_paths}
ORACLES = {"corpus_root": ROOT, "cleaned_texts": CLEANED, "retained_paths": RETAINED}

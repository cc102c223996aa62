"""Joins with contracts, ends of orders, retention, bins and inflections over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions import text as TX
from lumenfold.operators import joins as J


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined_with_status(spark, sf_dir):
    """Orders with their customer's segment, where the customer is in credit."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("custkey"), F.col("o_orderstatus").alias("kind"))
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("custkey"), F.col("c_mktsegment").alias("kind"))
    return J.contract_join(o, c, ["custkey"], status="join_status").select("o_orderkey", "custkey", "kind", "kind_right", "join_status")


STATUS = "SELECT o_orderkey, o_custkey AS custkey, o_orderstatus AS kind, c_mktsegment AS kind_right, CASE WHEN c_custkey IS NULL THEN 'missing' ELSE 'matched' END AS join_status FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0"


def one_to_many_join(spark, sf_dir):
    """Lines of every order, after the check that orders are unique and complete."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("orderkey"), "l_linenumber")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), "o_orderstatus")
    return J.contract_join(o, li, ["orderkey"], how="inner", promise="one_to_many")


ONE_TO_MANY = "SELECT o_orderkey AS orderkey, o_orderstatus, l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey"


def unmatched_rows(spark, sf_dir):
    """Customers without an urgent order that is finished."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'")
    c, o = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), "c_name"), urgent.select(F.col("o_custkey").alias("custkey"))
    return J.unmatched(c, o, ["custkey"])


UNMATCHED = "SELECT c_custkey AS custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')"


def head_and_tail(spark, sf_dir):
    """The ten lowest and the ten highest balances of customers."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return J.head_and_tail(c, [F.col("c_acctbal"), F.col("c_custkey")], 10).select("end", F.col("place").cast("bigint").alias("place"), "c_custkey", "c_acctbal")


ENDS = "SELECT * FROM (SELECT 'head' AS \"end\", row_number() OVER (ORDER BY c_acctbal, c_custkey) AS place, c_custkey, c_acctbal FROM customer UNION ALL SELECT 'tail', row_number() OVER (ORDER BY c_acctbal DESC, c_custkey DESC), c_custkey, c_acctbal FROM customer) WHERE place <= 10"


def top_retention(spark, sf_dir):
    """How many of the hundred parts sold most often are among those that bring most quantity."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").cast("double").alias("n"), F.sum("l_quantity").cast("double").alias("q"))
    return J.retention(li.select("l_partkey", F.col("n").alias("score")), li.select("l_partkey", F.col("q").alias("score")), "l_partkey", "score", 100)


RETENTION = "WITH s AS (SELECT l_partkey, count(*) AS n, sum(l_quantity)::DOUBLE AS q FROM lineitem GROUP BY 1), b AS (SELECT l_partkey FROM s ORDER BY n DESC, l_partkey LIMIT 100), a AS (SELECT l_partkey FROM s ORDER BY q DESC, l_partkey LIMIT 100) SELECT count(*) AS n_before, count(a.l_partkey) AS kept, count(a.l_partkey) / count(*) AS share FROM b LEFT JOIN a USING (l_partkey)"


def quantile_bins(spark, sf_dir):
    """Rows of each decile of the line numbers, whose equal edges are one."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("double").alias("v"))
    return J.quantile_bins(li, "v", "bin").groupBy("bin").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))


BINS = f"WITH e AS (SELECT DISTINCT unnest(quantile_cont(l_linenumber::DOUBLE, {[k / 10 for k in range(11)]})) AS e FROM lineitem), v AS (SELECT l_linenumber::DOUBLE AS v, count(*) AS n FROM lineitem GROUP BY 1) SELECT greatest((SELECT count(*) FROM e WHERE e.e < v.v), 1)::INT AS bin, sum(n)::BIGINT AS n, min(v) AS lo, max(v) AS hi FROM v GROUP BY 1"

#: Words of every rule, beside the words of the part names.
ENDINGS = ["inventories", "boxes", "box", "supply", "supplies", "stocking", "day", "glass", "buses", "churches", "dishes", "quiz", "ties", "is", "us", "fly", "gas", "suppliers"]


def inflected_terms(spark, sf_dir):
    """Regular inflections of the last word of part names and of words of every rule."""
    names = table(spark, sf_dir, "part").select(F.lower("p_name").alias("term")).distinct()
    terms = names.unionByName(spark.createDataFrame([(w,) for w in ENDINGS], "term string")).distinct()
    return terms.select("term", F.array_join(F.sort_array(TX.inflections(F.col("term"))), ";").alias("forms"))


INFLECTED = rf"""WITH t AS (SELECT DISTINCT lower(p_name) AS term FROM part UNION SELECT unnest({ENDINGS})), w AS (SELECT term, regexp_extract(term, '^(.*?)(\S+)$', 1) AS p, regexp_extract(term, '^(.*?)(\S+)$', 2) AS w FROM t),
f AS (SELECT term, p, w, CASE WHEN w LIKE '%ies' AND length(w) > 4 THEN [left(w, -3) || 'y'] WHEN regexp_matches(w, '(ses|xes|zes|ches|shes)$') THEN [left(w, -2)] WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN [left(w, -1)]
    ELSE list_concat([w || 's'], list_concat(CASE WHEN regexp_matches(w, '.[^aeiou]y$') THEN [left(w, -1) || 'ies'] ELSE [] END, CASE WHEN regexp_matches(w, '(s|x|z|ch|sh)$') THEN [w || 'es'] ELSE [] END)) END AS other FROM w)
SELECT term, array_to_string(list_sort(list_distinct(list_transform(list_concat([w], other), lambda x: p || x))), ';') AS forms FROM f"""

def stemmed_words(spark, sf_dir):
    """How often documents hold each rough stem, and by how many words; words are counted before they are cut."""
    words = table(spark, sf_dir, "documents").select(F.explode(TX.letter_words(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return words.groupBy(TX.rough_stem(F.col("w")).alias("stem")).agg(F.sum("n").alias("n"), F.count("*").alias("words"))


STEMMED = """WITH w AS (SELECT w, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+'))) AS w FROM documents) GROUP BY w), v AS (SELECT n, CASE WHEN length(w) > 5 AND w LIKE '%ing' THEN w[:-4] WHEN length(w) > 4 AND w LIKE '%ed' THEN w[:-3] ELSE w END AS w FROM w)
SELECT CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN w[:-4] || 'y' WHEN length(w) > 4 AND w LIKE '%sses' THEN w[:-3] WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END AS stem, sum(n)::BIGINT AS n, count(*) AS words FROM v GROUP BY 1"""

QUERIES = {"stemmed_words": stemmed_words, "joined_with_status": joined_with_status, "one_to_many_join": one_to_many_join, "unmatched_rows": unmatched_rows, "head_and_tail": head_and_tail, "top_retention": top_retention, "quantile_bins": quantile_bins, "inflected_terms": inflected_terms}
ORACLES = {"stemmed_words": STEMMED, "joined_with_status": STATUS, "one_to_many_join": ONE_TO_MANY, "unmatched_rows": UNMATCHED, "head_and_tail": ENDS, "top_retention": RETENTION, "quantile_bins": BINS, "inflected_terms": INFLECTED}

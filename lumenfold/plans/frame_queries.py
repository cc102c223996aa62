"""Queries over shapes of tables, complete cases, periods and statuses."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions import text as X
from lumenfold.functions import values as V
from lumenfold.operators import frames as FR
from lumenfold.plans.table_queries import table

FIRST, LAST = "1996Q1", "2000Q4"


def missing_cells(spark, sf_dir):
    """Which cells of a regression each line item lacks: a ratio without a denominator, a day, a flag out of the list."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate", F.try_divide("l_discount", "l_tax").alias("ratio"))
    judged = FR.with_missing(li, ["ratio", "l_shipdate"], {"flag": F.col("l_returnflag").isin("A", "N")})
    return judged.groupBy("l_suppkey", F.array_join("missing", ";").alias("missing")).agg(F.count("*").alias("n"))


MISSING = """WITH m AS (SELECT l_suppkey, concat_ws(';', CASE WHEN l_tax = 0 OR l_tax IS NULL OR l_discount IS NULL THEN 'ratio' END, CASE WHEN l_shipdate IS NULL THEN 'l_shipdate' END, CASE WHEN coalesce(l_returnflag NOT IN ('A', 'N'), true) THEN 'flag' END) AS missing FROM lineitem)
SELECT l_suppkey, missing, count(*) AS n FROM m GROUP BY ALL"""


def stacked_parties(spark, sf_dir):
    """Customers and suppliers as one table: keys and balances without their prefixes, what one side lacks is null."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    part = lambda df: FR.columns_of(df, suffix=("key", "acctbal", "segment"))
    named = lambda df, kind: df.select(F.lit(kind).alias("kind"), *[F.col(x).alias({"custkey": "id", "suppkey": "id"}.get(x[2:], x[2:])) for x in df.columns])
    return FR.stacked([named(part(c), "customer"), named(part(s), "supplier")])


STACKED = "SELECT 'customer' AS kind, c_custkey AS id, c_nationkey AS nationkey, c_acctbal AS acctbal, c_mktsegment AS mktsegment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_nationkey, s_acctbal, NULL FROM supplier"


def study_places(spark, sf_dir):
    """Orders in, before and after a study period by their quarter, late ones with labels in small letters and some without."""
    o = table(spark, sf_dir, "orders")
    label = F.when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit(" "), F.lower(V.quarter_label(F.col("o_orderdate"))))).when(F.col("o_orderstatus") == "P", F.year("o_orderdate").cast("string")).otherwise(V.quarter_label(F.col("o_orderdate")))
    return o.select(label.alias("label")).groupBy("label").agg(F.count("*").alias("n")).withColumn("place", FR.study_place(F.col("label"), FIRST, LAST))


PLACES = f"""WITH o AS (SELECT *, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS q FROM orders), l AS (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN ' ' || lower(q) WHEN o_orderstatus = 'P' THEN year(o_orderdate)::VARCHAR ELSE q END AS label, q, o_orderpriority <> '5-LOW' AND o_orderstatus = 'P' AS bare FROM o)
SELECT label, count(*) AS n, CASE WHEN bare OR q IS NULL THEN 'malformed' WHEN q < '{FIRST}' THEN 'before' WHEN q > '{LAST}' THEN 'after' ELSE 'in' END AS place FROM l GROUP BY ALL"""


def zero_flips(spark, sf_dir):
    """How each user's count of purchases moved from or to zero between the two halves of a day."""
    e = table(spark, sf_dir, "events").where("user_id is not null and ts is not null")
    count = lambda half: F.count_if((F.col("event_type") == "purchase") & ((F.hour("ts") >= 12) == half))
    return e.groupBy("user_id", F.to_date("ts").alias("day")).agg(count(False).alias("before"), count(True).alias("after")).withColumn("flip", FR.zero_flip(F.col("before"), F.col("after")))


FLIPS = """WITH c AS (SELECT user_id, ts::DATE AS day, count(*) FILTER (event_type = 'purchase' AND hour(ts) < 12) AS before, count(*) FILTER (event_type = 'purchase' AND hour(ts) >= 12) AS after FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2)
SELECT *, (CASE WHEN before = 0 THEN 'zero' ELSE 'positive' END) || CASE WHEN (before = 0) = (after = 0) THEN '_in_both' WHEN after = 0 THEN '_to_zero' ELSE '_to_positive' END AS flip FROM c"""


def payload_classes(spark, sf_dir):
    """Conversations as collected payloads in six classes, from their words, speakers and marks; a turn's marks are found in
    the turn, so no conversation is put together."""
    turns = table(spark, sf_dir, "conversations").where("conv_id is not null").select("conv_id", "role", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    flagged = turns.select("conv_id", "role", X.word_count(F.col("text")).alias("words"), FR.first_mark(F.col("text"), ["quevi", "ouch"]).alias("placeholder"), F.contains("text", F.lit("the ")).alias("named"))
    calls = flagged.groupBy("conv_id").agg(F.sum("words").alias("words"), F.count_distinct("role").alias("speakers"), F.min("placeholder").alias("placeholder"), F.max("named").alias("named"))
    k, text = F.col("conv_id"), F.lit(None).cast("string")
    verdict = FR.payload_class(
        exists=k % 11 != 0, parse_error=text, verified=k % 13 != 0, provider_class=F.lit("success"), provider_reason=text, words=F.col("words"), speakers=F.col("speakers"), placeholder=F.col("placeholder"), cut=text,
        payload_symbol=F.when(k % 17 == 0, "OTHER").otherwise(""), symbol=F.lit("own"), payload_quarter=F.when(k % 19 == 0, "2010Q2"), quarter=F.lit("2010Q1"), ticker_conflict=k % 3 == 0, issuer_named=F.col("named"),
    )
    return calls.select("conv_id", "words", "speakers", verdict.alias("v")).select("conv_id", "words", "speakers", "v.*")


PAYLOADS = r"""WITH t AS (SELECT conv_id, role, lower(coalesce(text, '')) AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id AS k, sum(len(regexp_extract_all(text, '\S+')))::BIGINT AS words, count(DISTINCT role) AS speakers, min(CASE WHEN contains(text, 'quevi') THEN 'quevi' WHEN contains(text, 'ouch') THEN 'ouch' END) AS mark, bool_or(contains(text, 'the ')) AS named FROM t GROUP BY 1),
v AS (SELECT *, CASE WHEN k % 11 = 0 THEN 'technical_failure: unreadable or missing payload: ' WHEN k % 13 = 0 THEN 'quarantine: raw payload sha256 does not match the recorded collection hash' WHEN words = 0 THEN 'technical_failure: empty payload without a routine no-transcript status'
    WHEN mark IS NOT NULL THEN 'invalid_content: confirmed non-transcript marker: ' || mark WHEN k % 17 = 0 THEN 'identity_mismatch: payload symbol OTHER differs from requested ticker' WHEN k % 19 = 0 THEN 'identity_mismatch: payload quarter 2010Q2 differs from requested quarter'
    WHEN words < 150 OR speakers < 2 THEN 'quarantine: content is too short or structurally incomplete' WHEN k % 3 = 0 AND NOT named THEN 'quarantine: ticker reuse overlaps another CIK and issuer text does not resolve it'
    WHEN NOT named THEN 'valid: request identity agrees; issuer name is not explicit in opening text' ELSE 'valid: structural content and request identity checks passed' END AS v FROM c)
SELECT k AS conv_id, words, speakers, regexp_extract(v, '^([a-z_]+): ', 1) AS classification, substr(v, length(regexp_extract(v, '^([a-z_]+): ')) + 1) AS reason FROM v"""

QUERIES = {"missing_cells": missing_cells, "stacked_parties": stacked_parties, "study_places": study_places, "zero_flips": zero_flips, "payload_classes": payload_classes}
ORACLES = {"missing_cells": MISSING, "stacked_parties": STACKED, "study_places": PLACES, "zero_flips": FLIPS, "payload_classes": PAYLOADS}

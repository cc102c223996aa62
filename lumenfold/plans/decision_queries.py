"""Decisions over the orders table: a ledger with planted faults, its overlay, periods by exact evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import decisions as D
from lumenfold.plans.table_queries import table


def _records(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("call_id"), F.col("o_custkey").cast("string").alias("cik"), F.concat(F.year("o_orderdate").cast("string"), F.lit("Q"), F.quarter("o_orderdate").cast("string")).alias("quarter_label"), F.to_date("o_orderdate").cast("string").alias("call_date"), F.lit("2000-01-01").alias("confirmed_call_date"), F.lit("press").alias("confirmed_call_date_source"), F.col("o_orderkey").alias("k"))


def _ledger(spark, sf_dir):
    """A decision for most orders, each kind of fault by the order's number and status."""
    o = table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey")).withColumn("day", F.to_date("o_orderdate"))
    if_ = lambda c, a, b: F.when(c, a).otherwise(b)
    k = lambda n, r: F.col("k") % n == r
    open_ = F.col("o_orderstatus") == "P"
    label = F.concat(F.year("day").cast("string"), F.lit("Q"), F.quarter("day").cast("string"))
    end = F.last_day(F.add_months(F.trunc("day", "quarter"), -1))
    rows = o.where(~k(41, 0)).select(
        F.col("k").cast("string").alias("call_id"), if_(k(43, 1), F.lit("0"), F.col("o_custkey").cast("string")).alias("cik"), if_(k(47, 2), F.lit(""), label).alias("provider_quarter_label"),
        if_(open_, F.lit(""), label).alias("fiscal_period_label"), if_(open_, F.lit(""), if_(k(53, 3), F.date_add("day", 5), end).cast("string")).alias("fiscal_period_end"),
        if_(open_ & ~k(7, 0), F.lit(""), F.date_add(F.trunc("day", "month"), 14).cast("string")).alias("release_date"), if_(k(59, 4), F.lit("guessed"), if_(open_, F.lit("unresolved"), F.element_at(F.array(*map(F.lit, D.ACCEPTED)), (F.col("k") % 3 + 1).cast("int")))).alias("status"),
        F.lit("https://issuer.example/release").alias("source_url"), if_(k(61, 5), F.lit(None).cast("string"), F.lit("Issuer release")).alias("evidence"), if_(k(11, 6), F.lit("duplicate_issuer_release;late"), F.lit("")).alias("audit_flags"),
        if_(k(67, 7), F.lit("unresolved_period"), F.lit("matched_issuer_period")).alias("transcript_status"), if_(k(2, 0), F.concat(F.lit("two releases "), (F.col("k") % 4).cast("string")), F.lit("")).alias("collision_adjudication"), if_(k(2, 0), F.lit("https://issuer.example/adjudication"), F.lit(None).cast("string")).alias("collision_adjudication_url"),
    )
    return rows.unionByName(rows.where(F.col("call_id").cast("bigint") % 71 == 8)).unionByName(rows.where(F.col("call_id").cast("bigint") % 73 == 9).withColumn("call_id", F.concat(F.lit("x"), "call_id")))


_LEDGER = """r AS (SELECT o_orderkey::VARCHAR AS call_id, o_custkey::VARCHAR AS cik, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS label FROM orders),
l0 AS (SELECT o_orderkey AS k, o_orderkey::VARCHAR AS call_id, CASE WHEN o_orderkey % 43 = 1 THEN '0' ELSE o_custkey::VARCHAR END AS cik, year(day) || 'Q' || quarter(day) AS label, CASE WHEN o_orderkey % 47 = 2 THEN '' ELSE year(day) || 'Q' || quarter(day) END AS provider,
    CASE WHEN o_orderstatus = 'P' THEN '' ELSE year(day) || 'Q' || quarter(day) END AS period, CASE WHEN o_orderstatus = 'P' THEN '' WHEN o_orderkey % 53 = 3 THEN (day + 5)::VARCHAR ELSE (date_trunc('quarter', day)::DATE - 1)::VARCHAR END AS fiscal_end,
    CASE WHEN o_orderstatus = 'P' AND o_orderkey % 7 <> 0 THEN '' ELSE (date_trunc('month', day)::DATE + 14)::VARCHAR END AS release, CASE WHEN o_orderkey % 59 = 4 THEN 'guessed' WHEN o_orderstatus = 'P' THEN 'unresolved' ELSE (['verified_correction', 'verified_existing', 'screened_existing'])[o_orderkey % 3 + 1] END AS status,
    CASE WHEN o_orderkey % 61 = 5 THEN '' ELSE 'Issuer release' END AS evidence, o_orderkey % 11 = 6 AS flagged, o_orderkey % 67 = 7 AS unidentified, CASE WHEN o_orderkey % 2 = 0 THEN 'two releases ' || o_orderkey % 4 ELSE '' END AS opinion, o_orderkey % 2 = 0 AS adjudicated
    FROM (SELECT *, o_orderdate::DATE AS day FROM orders) WHERE o_orderkey % 41 <> 0),
l AS (SELECT *, status IN ('verified_correction', 'verified_existing', 'screened_existing') AS ok FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l0 WHERE k % 71 = 8 UNION ALL SELECT k, 'x' || call_id, * EXCLUDE (k, call_id) FROM l0 WHERE k % 73 = 9))"""

LEDGER = f"""WITH {_LEDGER}, m AS (SELECT l.*, r.call_id AS known, r.cik AS own_cik, r.label AS own_label, count(*) OVER (PARTITION BY l.call_id) AS times,
    count(*) FILTER (release <> '') OVER (PARTITION BY l.cik, release) AS members, count(*) FILTER (NOT adjudicated) OVER (PARTITION BY l.cik, release) AS still_open, min(opinion) OVER (PARTITION BY l.cik, release) <> max(opinion) OVER (PARTITION BY l.cik, release) AS split,
    count(*) FILTER (ok) OVER (PARTITION BY l.cik, period) AS transcripts, lag(release) OVER (PARTITION BY l.cik, ok ORDER BY fiscal_end, l.call_id) AS earlier FROM l LEFT JOIN r ON l.call_id = r.call_id),
v AS (SELECT call_id, concat_ws(';', CASE WHEN known IS NULL THEN 'unknown_call' END, CASE WHEN times > 1 THEN 'repeated_call' END, CASE WHEN cik <> own_cik THEN 'other_issuer' END, CASE WHEN provider <> own_label THEN 'other_provider_call' END,
    CASE WHEN status = 'guessed' THEN 'unknown_disposition' END, CASE WHEN ok AND (period = '' OR fiscal_end = '' OR release = '' OR evidence = '') THEN 'lacks_evidence' END, CASE WHEN ok AND release < fiscal_end THEN 'predates_period' END, CASE WHEN NOT ok AND release <> '' THEN 'unresolved_with_event' END,
    CASE WHEN flagged AND NOT adjudicated THEN 'original_collision_open' END, CASE WHEN ok AND unidentified THEN 'identity_unresolved' END, CASE WHEN release <> '' AND members > 1 AND still_open > 0 THEN 'shared_event_open' END, CASE WHEN release <> '' AND members > 1 AND still_open = 0 AND split THEN 'collision_disagrees' END,
    CASE WHEN ok AND transcripts > 1 THEN 'several_transcripts' END, CASE WHEN ok AND earlier > release THEN 'release_order' END) AS reasons FROM m
    UNION ALL SELECT call_id, 'missing_decision' FROM r WHERE call_id NOT IN (SELECT call_id FROM l))
SELECT call_id, CASE WHEN reasons = '' THEN 'accepted' ELSE split_part(reasons, ';', 1) END AS verdict, reasons FROM v"""


def decision_ledger(spark, sf_dir):
    """The verdict on every decision, and all its reasons."""
    judged = D.validated_decisions(_records(spark, sf_dir).drop("k"), _ledger(spark, sf_dir))
    return judged.select("call_id", "verdict", F.array_join("reasons", ";").alias("reasons"))


def decision_overlay(spark, sf_dir):
    """Orders after the decisions that break no rule were applied, with the cells' sources."""
    judged = D.validated_decisions(_records(spark, sf_dir).drop("k"), _ledger(spark, sf_dir)).where("verdict = 'accepted'")
    out = D.applied_decisions(_records(spark, sf_dir).drop("k"), judged.drop("verdict", "reasons"))
    return out.select("call_id", "call_date", "date_status", "date_fiscal_date_ending", "confirmed_call_date", "confirmed_call_date_source", "call_date_confirmation_status", F.col("cell_sources")["call_date"].alias("call_date_from"), F.col("cell_sources")["confirmed_call_date"].alias("confirmed_from"))


OVERLAY = f"""WITH v AS ({LEDGER}), {_LEDGER}, d AS (SELECT l.* FROM l JOIN v USING (call_id) WHERE verdict = 'accepted')
SELECT o.call_id, CASE WHEN d.call_id IS NULL THEN o.day WHEN ok THEN release ELSE '' END AS call_date, status AS date_status, fiscal_end AS date_fiscal_date_ending,
    CASE WHEN d.status <> 'screened_existing' THEN '' ELSE '2000-01-01' END AS confirmed_call_date, CASE WHEN d.status <> 'screened_existing' THEN '' ELSE 'press' END AS confirmed_call_date_source, CASE WHEN d.status <> 'screened_existing' THEN 'not_revalidated_in_release_date_audit' END AS call_date_confirmation_status,
    CASE WHEN d.call_id IS NULL THEN 'original' ELSE 'decision' END AS call_date_from, CASE WHEN d.status <> 'screened_existing' THEN 'cleared' ELSE 'original' END AS confirmed_from
FROM (SELECT o_orderkey::VARCHAR AS call_id, o_orderdate::DATE::VARCHAR AS day FROM orders) o LEFT JOIN d ON o.call_id = d.call_id"""


def evidenced_periods(spark, sf_dir):
    """Each order's ship date as a period's end, met with the receipts that name exactly that date."""
    li = table(spark, sf_dir, "lineitem")
    provider = li.select(F.col("l_orderkey").alias("issuer"), F.to_date("l_shipdate").alias("fiscal_date_ending"), F.when(F.col("l_linenumber") % 5 > 0, F.date_add(F.to_date("l_shipdate"), (F.col("l_partkey") % 9 - 1).cast("int"))).alias("reported_date"))
    periods = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("issuer")).agg(F.date_add(F.to_date(F.min("l_shipdate")), (F.col("l_orderkey") % 4 == 3).cast("int")).alias("fiscal_period_end"))
    periods = periods.select("issuer", F.concat(F.lit("Q"), F.quarter("fiscal_period_end").cast("string")).alias("quarter_label"), "fiscal_period_end", F.lit("https://issuer.example").alias("source_url"), F.when(F.col("issuer") % 10 > 0, "Issuer calendar").alias("evidence"))
    return D.evidenced_periods(provider, periods, on=["issuer"]).select("issuer", "quarter_label", "fiscal_date_ending", "reported_date", "status")


EVIDENCED = """WITH p AS (SELECT l_orderkey AS issuer, l_shipdate::DATE AS e, l_shipdate::DATE + (l_partkey % 9 - 1)::INT AS d FROM lineitem WHERE l_linenumber % 5 > 0), c AS (SELECT issuer, e, min(d) AS d, count(DISTINCT d) AS n FROM p GROUP BY ALL),
f AS (SELECT l_orderkey AS issuer, min(l_shipdate)::DATE + (l_orderkey % 4 = 3)::INT AS e FROM lineitem GROUP BY l_orderkey)
SELECT f.issuer, 'Q' || quarter(f.e) AS quarter_label, f.e::VARCHAR AS fiscal_date_ending, CASE WHEN f.issuer % 10 > 0 AND n = 1 AND d >= f.e THEN d::VARCHAR END AS reported_date, CASE WHEN f.issuer % 10 = 0 THEN 'lacks_evidence' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' WHEN d < f.e THEN 'predates' ELSE 'matched' END AS status FROM f LEFT JOIN c ON f.issuer = c.issuer AND f.e = c.e"""

QUERIES = {"decision_ledger": decision_ledger, "decision_overlay": decision_overlay, "evidenced_periods": evidenced_periods}
ORACLES = {"decision_ledger": LEDGER, "decision_overlay": OVERLAY, "evidenced_periods": EVIDENCED}

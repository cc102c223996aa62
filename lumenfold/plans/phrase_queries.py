"""Queries over dates that texts announce and vocabularies with all forms of their terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions import text as TX
from lumenfold.operators import call_dates as D
from lumenfold.plans.table_queries import table


def announced_calls(spark, sf_dir):
    """Calls that releases of orders announce, in three spellings of a date: after the cue, before it, or none."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.to_date("o_orderdate").alias("d"))
    day = F.dayofmonth("d")
    suffix = F.when(day.isin(11, 12, 13), "th").when(day % 10 == 1, "st").when(day % 10 == 2, "nd").when(day % 10 == 3, "rd").otherwise("th")
    long, short = F.date_format("d", "MMMM d, yyyy"), F.concat(F.date_format("d", "MMM"), F.lit(". "), day, suffix, F.lit(", "), F.year("d"))
    opening = F.concat(F.lit("Results of the quarter ended December 31, 2000 were released. "), F.repeat(F.lit("Revenue rose again. "), F.lit(10)))
    said = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("The company will host a conference call on "), short, F.lit(" at 8 a.m."))).when(F.col("o_orderstatus") == "O", F.concat(F.lit("On "), long, F.lit(" the company plans to host its webcast in the morning."))).otherwise(F.concat(F.lit("Filed "), long, F.lit(". No earnings call is held.")))
    found = D.call_dates(o.select("o_orderkey", F.concat(opening, said).alias("text")), "text", id_col="o_orderkey")
    return found.select("o_orderkey", "place", "day", F.substr("excerpt", F.greatest(F.length("excerpt") - 29, F.lit(1))).alias("ending"))


ANNOUNCED = r"""WITH o AS (SELECT o_orderkey, o_orderstatus AS s, o_orderdate::DATE AS d, day(o_orderdate) AS k FROM orders),
t AS (SELECT o_orderkey, CASE s WHEN 'F' THEN 'The company will host a conference call on ' || strftime(d, '%b') || '. ' || k || CASE WHEN k IN (11, 12, 13) THEN 'th' WHEN k % 10 = 1 THEN 'st' WHEN k % 10 = 2 THEN 'nd' WHEN k % 10 = 3 THEN 'rd' ELSE 'th' END || ', ' || year(d) || ' at 8 a.m.'
    WHEN 'O' THEN 'On ' || strftime(d, '%B') || ' ' || k || ', ' || year(d) || ' the company plans to host its webcast in the morning.' END AS text FROM o),
x AS (SELECT *, regexp_extract(text, '(?:conference call on|^On) ([A-Z][a-z]{2})[a-z]*\.? (\d{1,2})(?:st|nd|rd|th)?, (20\d\d)', ['m', 'd', 'y']) AS p FROM t WHERE text IS NOT NULL)
SELECT o_orderkey, 0 AS place, strptime(p.m || ' ' || p.d || ' ' || p.y, '%b %d %Y')::DATE AS day, right(text, 30) AS ending FROM x WHERE p.y <> ''"""


def weighted_forms(spark, sf_dir):
    """Words of the documents, weighing their counts, with their regular forms, each at the largest weight that leads to it."""
    words = table(spark, sf_dir, "documents").select(F.explode(TX.letter_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("weight"))
    return D.with_inflections(words)


FORMS = r"""WITH w AS (SELECT w, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+'))) AS w FROM documents) GROUP BY w),
f AS (SELECT w, n, unnest(list_distinct(list_concat([w], CASE WHEN w LIKE '%ies' AND length(w) > 4 THEN [left(w, -3) || 'y'] WHEN regexp_matches(w, '(ses|xes|zes|ches|shes)$') THEN [left(w, -2)] WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN [left(w, -1)]
    ELSE list_concat([w || 's'], list_concat(CASE WHEN regexp_matches(w, '.[^aeiou]y$') THEN [left(w, -1) || 'ies'] ELSE [] END, CASE WHEN regexp_matches(w, '(s|x|z|ch|sh)$') THEN [w || 'es'] ELSE [] END)) END))) AS term FROM w)
SELECT term, max(n)::DOUBLE AS weight, arg_min(w, (-n, w)) AS source FROM f GROUP BY term"""

QUERIES = {"announced_calls": announced_calls, "weighted_forms": weighted_forms}
ORACLES = {"announced_calls": ANNOUNCED, "weighted_forms": FORMS}

"""Queries of entity resolution and dates in text over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions import text as TX
from lumenfold.operators import matching as M
from lumenfold.operators import temporal as T


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cascade_match(spark, sf_dir):
    """Parts to a part of equal name, else of equal brand, type and size, else of equal brand and type; unique only."""
    p = table(spark, sf_dir, "part")
    half, rest = p.where("p_partkey % 3 > 0"), p.where("p_partkey % 3 = 0")
    three, two = F.concat_ws("|", "p_brand", "p_type", F.col("p_size").cast("string")), F.concat_ws("|", "p_brand", "p_type")
    steps = [("name", F.col("p_name"), M.unique_matches(half, F.col("p_name"), "p_partkey")), ("brand_type_size", three, M.unique_matches(half, three, "p_partkey")), ("brand_type", two, M.unique_matches(half, two, "p_partkey"))]
    return M.cascade(rest, steps).select("p_partkey", F.coalesce("match", F.lit(-1).cast("bigint")).alias("match"), "match_rule")


def _step(n: int, key: str) -> str:
    return f"u{n} AS (SELECT {key} AS k, min(p_partkey) AS v FROM part WHERE p_partkey % 3 > 0 GROUP BY 1 HAVING count(DISTINCT p_partkey) = 1)"


CASCADE = f"""WITH {_step(1, 'p_name')}, {_step(2, "p_brand || '|' || p_type || '|' || p_size")}, {_step(3, "p_brand || '|' || p_type")}
SELECT p_partkey, coalesce(u1.v, u2.v, u3.v, -1) AS match, CASE WHEN u1.v IS NOT NULL THEN 'name' WHEN u2.v IS NOT NULL THEN 'brand_type_size' WHEN u3.v IS NOT NULL THEN 'brand_type' ELSE 'unmatched' END AS match_rule
FROM part LEFT JOIN u1 ON p_name = u1.k LEFT JOIN u2 ON p_brand || '|' || p_type || '|' || p_size = u2.k LEFT JOIN u3 ON p_brand || '|' || p_type = u3.k WHERE p_partkey % 3 = 0"""


def fuzzy_match(spark, sf_dir):
    """Benchmark items to the document that shares most long words, if one is strictly best."""
    words = TX.scorer_tokens(F.col("text"))
    items, docs = table(spark, sf_dir, "benchmark").select("item_id", words.alias("w")), table(spark, sf_dir, "documents").select("doc_id", words.alias("w"))
    return M.most_shared_words(items, docs, left_id="item_id", right_id="doc_id", words="w", least_length=6)


_WORDS = "unnest(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+(?:[''’.\\-][A-Za-z0-9]+)*'), lambda x: lower(x))))"
FUZZY = f"""WITH i AS (SELECT * FROM (SELECT doc_id AS r, {_WORDS} AS w FROM documents) WHERE length(w) >= 6), c AS (SELECT w FROM i GROUP BY w HAVING count(*) * 10 < (SELECT count(*) FROM documents)), p AS (SELECT item_id AS l, {_WORDS} AS w FROM benchmark),
n AS (SELECT l, r, count(*) AS shared FROM p JOIN c USING (w) JOIN i USING (w) GROUP BY l, r), t AS (SELECT *, row_number() OVER v AS place, lead(shared) OVER v AS next FROM n WINDOW v AS (PARTITION BY l ORDER BY shared DESC, r))
SELECT l AS item_id, r AS best, shared FROM t WHERE place = 1 AND (next IS NULL OR next < shared)"""


def security_exclusions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("common stock", "Growth Fund", "Depositary Share", "Wts", "Acquisition Corp")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    symbol = F.concat(F.lit("S"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 7 == 0, "-WS").otherwise(""))
    return p.groupBy(F.coalesce(M.exclusion(F.concat_ws(" ", "p_name", kinds), symbol), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


EXCLUSIONS = "WITH s AS (SELECT lower(p_name || ' ' || (['common stock', 'Growth Fund', 'Depositary Share', 'Wts', 'Acquisition Corp'])[p_partkey % 5 + 1]) AS n, 'S' || p_size || CASE WHEN p_partkey % 7 = 0 THEN '-WS' ELSE '' END AS s FROM part) SELECT CASE WHEN regexp_matches(s, '[-.](P[A-Z]?|W|WS|U|R)$') THEN 'symbol' " + " ".join(f"WHEN regexp_matches(n, '{p}') THEN '{r}'" for r, p in M.EXCLUDED_NAMES.items()) + " ELSE 'kept' END AS reason, count(*) AS n FROM s GROUP BY 1"


def dates_in_text(spark, sf_dir):
    """Order days written into sentences three ways, and read again."""
    d = F.to_date("o_orderdate")
    said = F.concat(F.lit("The call of "), F.element_at(F.array(F.date_format(d, "MMMM d, yyyy"), F.date_format(d, "d MMMM yyyy"), F.date_format(d, "yyyy-MM-dd")), (F.col("o_orderkey") % 3 + 1).cast("int")), F.lit(" covered Q"), F.quarter(d).cast("string"), F.lit(" "), F.year(d).cast("string"), F.lit(" and 31 february 2001."))
    o = table(spark, sf_dir, "orders").select("o_orderkey", d.alias("d"), said.alias("t"))
    return o.select("o_orderkey", F.array_join(F.transform(M.text_dates(F.col("t")), lambda x: x.cast("string")), ";").alias("dates"), M.quarter_mention(F.col("t"), F.year("d"), F.quarter("d")).alias("own_quarter"), M.quarter_mention(F.col("t"), F.year("d") + 1, F.quarter("d")).alias("next_year"))


_MONTH = "(?:january|february|march|april|may|june|july|august|september|october|november|december)"
DATES = rf"""WITH s AS (SELECT o_orderkey, o_orderdate::DATE AS d, 'The call of ' || (CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%B %-d, %Y') WHEN 1 THEN strftime(o_orderdate, '%-d %B %Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END) || ' covered Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) || ' and 31 february 2001.' AS t FROM orders),
f AS (SELECT o_orderkey, d, t, list_concat(list_transform(regexp_extract_all(lower(t), '\b{_MONTH}\s+\d{{1,2}},?\s+\d{{4}}\b'), lambda x: try_strptime(replace(x, ',', ''), '%B %d %Y')), list_transform(regexp_extract_all(lower(t), '\b\d{{1,2}}\s+{_MONTH}\s+\d{{4}}\b'), lambda x: try_strptime(x, '%d %B %Y')), list_transform(regexp_extract_all(t, '\b\d{{4}}-\d{{2}}-\d{{2}}\b'), lambda x: try_strptime(x, '%Y-%m-%d'))) AS found FROM s)
SELECT o_orderkey, array_to_string(list_transform(list_filter(found, lambda x: x IS NOT NULL), lambda x: x::DATE::VARCHAR), ';') AS dates, regexp_matches(t, 'Q' || quarter(d) || ' ' || year(d) || '\b') AS own_quarter, regexp_matches(t, 'Q' || quarter(d) || ' ' || (year(d) + 1) || '\b') AS next_year FROM f""".replace("\\\\", "\\")


def live_calls(spark, sf_dir):
    """Sentences on each order's day, of a call, a replay and others in turn, and what they say of the day."""
    d = F.to_date("o_orderdate")
    full, short = F.date_format(d, "MMMM d, yyyy"), F.date_format(d, "MMM. d")
    said = [F.concat(F.lit("We will hold a conference call on "), full, F.lit(".")), F.concat(F.lit("A replay of the conference call will be available through "), full, F.lit(".")), F.concat(F.lit("The earnings call is scheduled for "), short, F.lit(".")), F.concat(F.lit("Our analyst day is on "), full, F.lit("."))]
    o = table(spark, sf_dir, "orders")
    return o.groupBy((F.col("o_orderkey") % 4).alias("kind"), M.live_call(d, F.element_at(F.array(*said), (F.col("o_orderkey") % 4 + 1).cast("int"))).alias("verdict")).agg(F.count("*").alias("n"))


LIVE = "SELECT o_orderkey % 4 AS kind, (['live', 'replay', 'live_year_implied', 'no_schedule'])[o_orderkey % 4 + 1] AS verdict, count(*) AS n FROM orders GROUP BY ALL"


def name_reuse(spark, sf_dir):
    """Suppliers of a part whose shipping spans overlap another supplier's."""
    spans = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.to_date(F.min("l_shipdate")).alias("a"), F.to_date(F.max("l_shipdate")).alias("b"))
    return M.reused_names(spans, name="l_partkey", entity="l_suppkey", start="a", end="b")


REUSE = "WITH s AS (SELECT l_partkey, l_suppkey, min(l_shipdate) AS a, max(l_shipdate) AS b FROM lineitem GROUP BY ALL) SELECT x.l_partkey, x.l_suppkey, string_agg(y.l_suppkey::VARCHAR, ';' ORDER BY y.l_suppkey) AS others FROM s x JOIN s y ON x.l_partkey = y.l_partkey AND x.l_suppkey <> y.l_suppkey AND x.a <= y.b AND y.a <= x.b GROUP BY ALL"


def fiscal_anniversaries(spark, sf_dir):
    """The fiscal quarter of each order's day for a year that ends in May of the next year."""
    d = F.to_date("o_orderdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", d.alias("d"), F.make_date(F.year(d) + F.when(F.month(d) > 5, 1).otherwise(0), F.lit(5), F.lit(31)).alias("fye"))
    q = M.fiscal_quarter(F.col("d"), F.col("fye"))
    return o.select("o_orderkey", F.coalesce(q.quarter.cast("bigint"), F.lit(-1).cast("bigint")).alias("quarter"), q.expected.cast("string").alias("expected"), F.coalesce(q.distance.cast("bigint"), F.lit(-1).cast("bigint")).alias("distance"))


ANNIVERSARIES = "WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d, make_date(year(o_orderdate) + (month(o_orderdate) > 5)::INT, 5, 31) AS fye FROM orders), t AS (SELECT o_orderkey, 4 - k AS q, (fye - to_months((3 * k)::INT))::DATE AS e, abs(d - (fye - to_months((3 * k)::INT))::DATE) AS x FROM o, range(4) r(k)), b AS (SELECT * FROM t WHERE x <= 35 QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY x, e) = 1) SELECT o.o_orderkey, coalesce(q, -1)::BIGINT AS quarter, e::VARCHAR AS expected, coalesce(x, -1)::BIGINT AS distance FROM o LEFT JOIN b USING (o_orderkey)"


def carried_state(spark, sf_dir):
    """Events with whether their user had bought before or now, and the days since the event before."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").withColumn("buy", F.col("event_type") == "purchase")
    out = T.carried_flag(e, "buy", "bought", by="user_id", order="event_id")
    w = Window.partitionBy("user_id").orderBy("event_id")
    return out.select("event_id", "user_id", "bought", F.coalesce(F.datediff(F.to_date("ts"), F.to_date(F.lag("ts").over(w))).cast("bigint"), F.lit(-1).cast("bigint")).alias("gap"), (F.row_number().over(w) - 1).cast("bigint").alias("before"))


CARRIED = "SELECT event_id, user_id, bool_or(event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS bought, coalesce((ts::DATE - (lag(ts) OVER w)::DATE)::BIGINT, -1) AS gap, (row_number() OVER w - 1)::BIGINT AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"

QUERIES = {"cascade_match": cascade_match, "fuzzy_match": fuzzy_match, "security_exclusions": security_exclusions, "dates_in_text": dates_in_text, "live_calls": live_calls, "name_reuse": name_reuse, "fiscal_anniversaries": fiscal_anniversaries, "carried_state": carried_state}
ORACLES = {"cascade_match": CASCADE, "fuzzy_match": FUZZY, "security_exclusions": EXCLUSIONS, "dates_in_text": DATES, "live_calls": LIVE, "name_reuse": REUSE, "fiscal_anniversaries": ANNIVERSARIES, "carried_state": CARRIED}

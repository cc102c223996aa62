"""Queries over the star schema and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.functions import values as V
from lumenfold.operators import allocation as A
from lumenfold.operators import inference as I
from lumenfold.operators import ranges as G
from lumenfold.operators import ranks as K
from lumenfold.operators import records as R
from lumenfold.operators import returns as RT
from lumenfold.operators import sampling as S
from lumenfold.operators import temporal as T
from lumenfold.sources.storage import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark, sf_dir):
    """Orders of customers as scored events: a rounded score with ties, a stratum, a cluster, an outcome."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    joined = o.join(c, o.o_custkey == c.c_custkey)
    return joined.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cluster"), F.col("c_mktsegment").alias("stratum"), F.floor(F.col("o_totalprice") / 5000).cast("double").alias("score"), (F.pmod(F.col("o_orderkey"), F.lit(7)) * 1.0).alias("second"), (F.pmod(F.col("o_orderkey") * 37 + F.col("o_custkey") * 11, F.lit(1009)) / 100.0).alias("outcome"), V.quarter_label(F.to_date("o_orderdate")).alias("period"), "o_orderstatus", "o_orderpriority", "o_totalprice", F.to_date("o_orderdate").alias("day"))


CALLS = """calls AS (SELECT o_orderkey AS id, o_custkey AS cluster, c_mktsegment AS stratum, floor(o_totalprice / 5000)::DOUBLE AS score, (o_orderkey % 7)::DOUBLE AS second, ((o_orderkey * 37 + o_custkey * 11) % 1009) / 100.0::DOUBLE AS outcome,
    year(o_orderdate) || 'Q' || quarter(o_orderdate) AS period, o_orderstatus, o_orderpriority, o_totalprice, o_orderdate::DATE AS day FROM orders JOIN customer ON o_custkey = c_custkey)"""


def winsorized_scores(spark, sf_dir):
    return A.winsorized(calls(spark, sf_dir), ["score", "o_totalprice"]).groupBy("stratum").agg(F.count("*").alias("n"), F.round(F.sum("score_winsor"), 6).alias("score"), F.round(F.avg("o_totalprice_winsor"), 6).alias("price"), F.min("score_winsor").alias("low"), F.max("score_winsor").alias("high"))


WINSOR = f"WITH {CALLS}, e AS (SELECT quantile_cont(score, 0.01) AS a, quantile_cont(score, 0.99) AS b, quantile_cont(o_totalprice, 0.01) AS c, quantile_cont(o_totalprice, 0.99) AS d FROM calls), w AS (SELECT stratum, least(greatest(score, a), b) AS s, least(greatest(o_totalprice, c), d) AS p FROM calls, e) SELECT stratum, count(*) AS n, round(sum(s), 6) AS score, round(avg(p), 6) AS price, min(s) AS low, max(s) AS high FROM w GROUP BY stratum"


def hash_quintiles(spark, sf_dir):
    one = A.equal_quintiles(calls(spark, sf_dir), "score", "id", "q", by=["stratum"])
    two = A.equal_quintiles(one, "second", "id", "q2", by=["stratum", "q"])
    return two.select("id", "stratum", "q", "q2")


QUINTILES = f"WITH {CALLS}, a AS (SELECT *, (floor((row_number() OVER (PARTITION BY stratum ORDER BY score, sha256('ties|' || id), id) - 1) * 5 / count(*) OVER (PARTITION BY stratum)) + 1)::INT AS q FROM calls) SELECT id, stratum, q, (floor((row_number() OVER (PARTITION BY stratum, q ORDER BY second, sha256('ties|' || id), id) - 1) * 5 / count(*) OVER (PARTITION BY stratum, q)) + 1)::INT AS q2 FROM a"


def nested_membership(spark, sf_dir):
    """Cells of score by second score with fractional ties, nested in the first."""
    outer = A.fractional_membership(calls(spark, sf_dir), "score", by=["stratum"], name="q", weight="w")
    return A.fractional_membership(outer, "second", by=["stratum", "q"], mass="w", name="q2", weight="w2")


def fractional_cells(spark, sf_dir):
    return nested_membership(spark, sf_dir).groupBy("stratum", "q", "q2").agg(F.round(F.sum("w2"), 6).alias("mass"), F.count("*").alias("member_rows"), F.count_distinct("id").alias("calls"), F.round(F.sum(F.col("w2") * F.col("outcome")) / F.sum("w2"), 6).alias("mean"))


def _fraction(name: str, rows: str, value: str, by: str, mass: str, q: str, w: str) -> str:
    part = f"PARTITION BY {by}"
    return f"""{name}_b AS (SELECT {by}, {value}, sum({mass}) AS m FROM {rows} GROUP BY {by}, {value}), {name}_c AS (SELECT *, sum(m) OVER ({part} ORDER BY {value} ROWS UNBOUNDED PRECEDING) AS e, sum(m) OVER ({part}) AS a FROM {name}_b),
{name}_s AS (SELECT {by}, {value}, k AS {q}, (least(e, k * a / 5) - greatest(e - m, (k - 1) * a / 5)) / m AS share FROM {name}_c, range(1, 6) r(k)), {name} AS (SELECT {rows}.*, {q}::INT AS {q}, {mass} * share AS {w} FROM {rows} JOIN {name}_s USING ({by}, {value}) WHERE share > 1e-12)"""


FRACTIONS = f"{CALLS}, {_fraction('outerm', 'calls', 'score', 'stratum', '1.0::DOUBLE', 'q', 'w')}, {_fraction('innerm', 'outerm', 'second', 'stratum, q', 'w', 'q2', 'w2')}"
CELLS = f"WITH {FRACTIONS} SELECT stratum, q, q2, round(sum(w2), 6) AS mass, count(*) AS member_rows, count(DISTINCT id) AS calls, round(sum(w2 * outcome) / sum(w2), 6) AS mean FROM innerm GROUP BY ALL"


def portfolio_means(spark, sf_dir):
    """Weighted means by quintile with errors clustered by customer."""
    m = A.fractional_membership(calls(spark, sf_dir), "score", by=["stratum"], name="q", weight="w")
    out = I.clustered_means(m, "outcome", "cluster", by=["q"], weight="w")
    return out.select("q", F.round("mean", 6).alias("mean"), F.round("se", 6).alias("se"), "n", F.round("mass", 6).alias("mass"), "clusters")


CLUSTER = "s AS (SELECT q, cluster, sum(w * outcome) AS wy, sum(w) AS m, count(*) AS n FROM outerm GROUP BY q, cluster), t AS (SELECT q, sum(wy) / sum(m) AS mean, sum(m) AS mass, count(*) AS g FROM s GROUP BY q)"
MEANS = f"WITH {FRACTIONS}, {CLUSTER} SELECT q, round(mean, 6) AS mean, round(sqrt(any_value(g) / (any_value(g) - 1) * sum(pow(wy - mean * m, 2))) / any_value(mass), 6) AS se, sum(n)::BIGINT AS n, round(any_value(mass), 6) AS mass, any_value(g) AS clusters FROM s JOIN t USING (q) GROUP BY q, mean"


def portfolio_covariance(spark, sf_dir):
    m = A.fractional_membership(calls(spark, sf_dir), "score", by=["stratum"], name="q", weight="w")
    return I.joint_covariance(m, "outcome", "cluster", "q", "w").select("a", "b", F.round("covariance", 9).alias("covariance"), "shared")


COVARIANCE = f"WITH {FRACTIONS}, {CLUSTER}, i AS (SELECT q, cluster, (wy - mean * m) / mass AS i FROM s JOIN t USING (q)), g AS (SELECT count(DISTINCT cluster) AS g FROM calls) SELECT x.q AS a, y.q AS b, round(sum(x.i * y.i) * any_value(g) / (any_value(g) - 1), 9) AS covariance, count(*) AS shared FROM i x JOIN i y ON x.cluster = y.cluster AND x.q <= y.q, g GROUP BY 1, 2"


def portfolio_contrasts(spark, sf_dir):
    m = A.fractional_membership(calls(spark, sf_dir), "score", by=["stratum"], name="q", weight="w")
    rows = I.contrasts(I.clustered_means(m, "outcome", "cluster", by=["q"], weight="w"), I.joint_covariance(m, "outcome", "cluster", "q", "w"), "q")
    out = spark.createDataFrame(rows, "a int, b int, difference double, se double, t double, p double")
    return out.select("a", "b", F.round("difference", 6).alias("difference"), F.round("se", 6).alias("se"), F.round("t", 5).alias("t"))


CONTRASTS = f"""WITH {FRACTIONS}, {CLUSTER}, i AS (SELECT q, cluster, (wy - mean * m) / mass AS i FROM s JOIN t USING (q)), g AS (SELECT count(DISTINCT cluster) AS g FROM calls), v AS (SELECT x.q AS a, y.q AS b, sum(x.i * y.i) * any_value(g) / (any_value(g) - 1) AS c FROM i x JOIN i y ON x.cluster = y.cluster, g GROUP BY 1, 2),
d AS (SELECT x.q AS a, y.q AS b, y.mean - x.mean AS d, sqrt((SELECT c FROM v WHERE v.a = x.q AND v.b = x.q) + (SELECT c FROM v WHERE v.a = y.q AND v.b = y.q) - 2 * coalesce((SELECT c FROM v WHERE v.a = x.q AND v.b = y.q), 0)) AS se FROM t x JOIN t y ON x.q < y.q) SELECT a, b, round(d, 6) AS difference, round(se, 6) AS se, round(d / se, 5) AS t FROM d"""


def sector_ranks(spark, sf_dir):
    return A.competition_rank(calls(spark, sf_dir), "score", "place", by=["stratum"]).select("id", "stratum", "score", F.col("place").cast("bigint").alias("place"), F.col("place_of").cast("bigint").alias("place_of"))


RANKS = f"WITH {CALLS} SELECT id, stratum, score, rank() OVER (PARTITION BY stratum ORDER BY score DESC)::BIGINT AS place, count(*) OVER (PARTITION BY stratum)::BIGINT AS place_of FROM calls"


def rank_correlations(spark, sf_dir):
    """Spearman's and Pearson's correlation of score and price by stratum."""
    c = calls(spark, sf_dir)
    plain = c.groupBy("stratum").agg(F.round(F.corr("score", "second"), 6).alias("pearson"))
    return K.spearman(c, "score", "second", by=["stratum"]).join(plain, "stratum").select("stratum", "n", F.round("spearman", 6).alias("spearman"), "pearson")


RANK_CORRELATIONS = f"WITH {CALLS}, r AS (SELECT *, rank() OVER (PARTITION BY stratum ORDER BY score) + (count(*) OVER (PARTITION BY stratum, score) - 1) / 2.0 AS x, rank() OVER (PARTITION BY stratum ORDER BY second) + (count(*) OVER (PARTITION BY stratum, second) - 1) / 2.0 AS y FROM calls) SELECT stratum, count(*) AS n, round(corr(x, y), 6) AS spearman, round(corr(score, second), 6) AS pearson FROM r GROUP BY stratum"


def zero_apart_bins(spark, sf_dir):
    return A.quantile_bins(calls(spark, sf_dir), "second", "bin").groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("outcome"), 6).alias("mean"))


BINS = f"WITH {CALLS}, e AS (SELECT quantile_cont(second, [0.2, 0.4, 0.6, 0.8]) AS e FROM calls WHERE second <> 0), b AS (SELECT CASE WHEN second = 0 THEN 0 ELSE 1 + len(list_filter(e, lambda x: x <= second)) END::INT AS bin, outcome FROM calls, e) SELECT bin, count(*) AS n, round(avg(outcome), 6) AS mean FROM b GROUP BY bin"



def _gates():
    return {"finished": F.col("o_orderstatus") == "F", "urgent_or_high": F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "large": F.col("o_totalprice") > 50_000}


def gate_funnel(spark, sf_dir):
    return R.gate_funnel(table(spark, sf_dir, "orders"), _gates())


FUNNEL = """WITH c AS (SELECT count(*) AS a, count(*) FILTER (o_orderstatus = 'F') AS b, count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')) AS c, count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice > 50000) AS d FROM orders)
SELECT 1::INT AS step, 'finished' AS gate, b AS retained, a - b AS excluded FROM c UNION ALL SELECT 2, 'urgent_or_high', c, b - c FROM c UNION ALL SELECT 3, 'large', d, c - d FROM c"""


def exclusion_reasons(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(R.exclusion_reasons(_gates()).alias("reasons")).agg(F.count("*").alias("n"))


REASONS = "SELECT concat_ws(';', CASE WHEN o_orderstatus <> 'F' THEN 'finished' END, CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 'urgent_or_high' END, CASE WHEN o_totalprice <= 50000 THEN 'large' END) AS reasons, count(*) AS n FROM orders GROUP BY 1"


def coverage_rollups(spark, sf_dir):
    return R.rollups(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], [F.count("*").alias("n"), F.round(F.sum("l_quantity"), 3).alias("quantity")])


ROLLUPS = "SELECT CASE WHEN grouping(l_returnflag) = 0 THEN 'l_returnflag' WHEN grouping(l_linestatus) = 0 THEN 'l_linestatus' ELSE 'l_linenumber' END AS dimension, coalesce(l_returnflag, l_linestatus, l_linenumber::VARCHAR) AS value, count(*) AS n, round(sum(l_quantity), 3) AS quantity FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_linenumber))"


def status_pivot(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in "FOP"), F.lit(0))
    return counts.select("o_orderpriority", *[F.coalesce(c, F.lit(0)).alias(f"n_{c.lower()}") for c in "FOP"], *[F.round(F.coalesce(F.col(c), F.lit(0)) / total, 9).alias(f"share_{c.lower()}") for c in "FOP"])


PIVOT = "SELECT o_orderpriority, " + ", ".join(f"count(*) FILTER (o_orderstatus = '{c}') AS n_{c.lower()}, round(count(*) FILTER (o_orderstatus = '{c}') / count(*) FILTER (o_orderstatus IN ('F', 'O', 'P')), 9) AS share_{c.lower()}" for c in "FOP") + " FROM orders GROUP BY o_orderpriority"


def describe_groups(spark, sf_dir):
    x, li = "l_extendedprice", table(spark, sf_dir, "lineitem")
    one = li.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_pop(x), 6).alias("sd"), F.count_distinct("l_suppkey").alias("suppliers"), F.round(F.corr("l_quantity", x), 6).alias("corr"), F.round(F.avg((F.col("l_discount") > 0.05).cast("int")), 9).alias("rate"))
    cut = K.percentiles(li, x, [0.1, 0.5, 0.9], by=["l_returnflag"], name="p")
    return one.join(cut, "l_returnflag").select("l_returnflag", "n", "mean", F.round(F.col("p")[1], 6).alias("median"), F.round(F.col("p")[0], 6).alias("p10"), F.round(F.col("p")[2], 6).alias("p90"), "sd", "suppliers", "corr", "rate")


DESCRIBE = "SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 6) AS mean, round(median(l_extendedprice), 6) AS median, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90, round(stddev_pop(l_extendedprice), 6) AS sd, count(DISTINCT l_suppkey) AS suppliers, round(corr(l_quantity, l_extendedprice), 6) AS corr, round(avg((l_discount > 0.05)::INT), 9) AS rate FROM lineitem GROUP BY l_returnflag"


def prices(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("date"), "l_extendedprice", "l_quantity")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    unit = F.sum("l_extendedprice") / F.sum("l_quantity")
    return li.join(part, li.l_partkey == part.p_partkey).groupBy(F.col("p_brand").alias("brand"), "date").agg(F.round(unit, 4).alias("price"))


PRICES = "prices AS (SELECT p_brand AS brand, l_shipdate::DATE AS date, round(sum(l_extendedprice) / sum(l_quantity), 4) AS price FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), days AS (SELECT date, (row_number() OVER (ORDER BY date) - 1)::INT AS t FROM (SELECT DISTINCT date FROM prices WHERE date IS NOT NULL))"


def daily_returns(spark, sf_dir):
    p = prices(spark, sf_dir)
    r = T.daily_returns(p, T.calendar(p, "date"), key="brand", date="date", price="price")
    return r.groupBy("brand").agg(F.count("*").alias("days"), F.count("ret").alias("n"), F.round(F.avg("ret"), 6).alias("mean"), F.round(F.max("ret"), 6).alias("largest"))


RETURNS = f"WITH {PRICES}, r AS (SELECT brand, t, price, lag(price) OVER w AS p, lag(t) OVER w AS u FROM prices JOIN days USING (date) WINDOW w AS (PARTITION BY brand ORDER BY t)), x AS (SELECT brand, CASE WHEN u = t - 1 AND p > 0 AND price > 0 THEN price / p - 1 END AS ret FROM r) SELECT brand, count(*) AS days, count(ret) AS n, round(avg(ret), 6) AS mean, round(max(ret), 6) AS largest FROM x GROUP BY brand"


def next_trading_day(spark, sf_dir):
    days = T.calendar(prices(spark, sf_dir).where("dayofweek(date) between 2 and 6"), "date")
    e = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return T.asof_forward(e, days, at="day").select("o_orderkey", "t")


NEXT_DAY = "WITH days AS (SELECT date, (row_number() OVER (ORDER BY date) - 1)::INT AS t FROM (SELECT DISTINCT l_shipdate::DATE AS date FROM lineitem JOIN part ON l_partkey = p_partkey WHERE dayofweek(l_shipdate) BETWEEN 1 AND 5)) SELECT o_orderkey, (SELECT min(t) FROM days WHERE date >= o_orderdate::DATE) AS t FROM orders"


def event_windows(spark, sf_dir):
    """The event study of every order's day on the mean price of its customer's segment. Factors are made from the
    calendar, without momentum on every 997th day."""
    o, c = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day")), table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    e = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("order_id"), "segment", "day")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("date"), "l_extendedprice", "l_quantity").where("date is not null")
    p = li.join(e, F.col("l_orderkey") == F.col("order_id")).groupBy("segment", "date").agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price"))
    days = materialize(T.calendar(p, "date"), "calendar")
    ret = T.daily_returns(p, days, key="segment", date="date", price="price")
    wave = lambda a, b: F.sin(F.col("t") * a) * b
    momentum = F.when(F.col("t") % 997 != 500, wave(2.9, 0.005))
    factors = days.select("t", wave(0.7, 0.01).alias("mkt_rf"), wave(1.3, 0.008).alias("smb"), wave(2.1, 0.006).alias("hml"), momentum.alias("mom"), F.lit(0.0001).alias("rf"))
    out = RT.event_study(T.asof_forward(e, days, at="day"), ret, factors, days, key="segment", at="day")
    text = [F.col(c).cast("string").alias(c) for c in ("event_trading_date", "estimation_start", "estimation_end")]
    fit = [F.round(c, 4).alias(c) for c in ("alpha", "b_mkt", "b_smb", "b_hml", "b_mom", "rmse", "r2", "car_0_1", "car_2_60")]
    return out.select("order_id", "segment", "status", *[F.col(c).cast("bigint").alias(c) for c in ("n_obs", "n_missing_prices", "n_missing_factors", "day_0_lag", "car_0_1_observations", "car_2_60_observations")], *text, "car_0_1_status", "car_2_60_status", "car_0_1_missing_dates", *fit)


def _study_sql() -> str:
    """Normal equations of each (segment, day) by joins and sums, solved by Gauss-Jordan elimination, a CTE a step."""
    xs, n = [f"x{j}" for j in range(5)], 5
    est, good = "u BETWEEN t - 209 AND t - 10", "y IS NOT NULL"
    sums = [f"sum(x{i} * x{j}) FILTER ({est} AND {good}) AS m{i}{j}" for i in range(n) for j in range(n)] + [f"sum(x{i} * y) FILTER ({est} AND {good}) AS m{i}5" for i in range(n)]
    sums += [f"sum(y * y) FILTER ({est} AND {good}) AS yy", f"sum(y) FILTER ({est} AND {good}) AS sy", *[f"sum(x{i} * y) FILTER ({est} AND {good}) AS q{i}" for i in range(n)]]
    for name, a, b in (("a", 0, 1), ("b", 2, 60)):
        at = f"u BETWEEN t + {a} AND t + {b}"
        sums += [f"count(y) FILTER ({at}) AS n{name}", f"sum(y) FILTER ({at} AND {good}) AS s{name}", *[f"sum({x}) FILTER ({at} AND {good}) AS {name}{x}" for x in xs]]
    steps, last = [], "sums"
    for k in range(n):
        rows = [f"m{i}{j} / m{k}{k} AS m{i}{j}" if i == k else f"m{i}{j} - m{i}{k} * m{k}{j} / m{k}{k} AS m{i}{j}" for i in range(n) for j in range(n + 1)]
        steps.append(f"step{k} AS (SELECT * REPLACE ({', '.join(rows)}) FROM {last})")
        last = f"step{k}"
    beta = "".join(f" - m{i}5 * q{i}" for i in range(n))
    car = lambda c: f"s{c}" + "".join(f" - m{i}5 * {c}x{i}" for i in range(n))
    names = ["alpha", "b_mkt", "b_smb", "b_hml", "b_mom"]
    return f"""WITH e AS (SELECT o_orderkey AS order_id, c_mktsegment AS segment, o_orderdate::DATE AS day FROM orders JOIN customer ON o_custkey = c_custkey),
prices AS (SELECT segment, l_shipdate::DATE AS date, sum(l_extendedprice) / sum(l_quantity) AS price FROM lineitem JOIN e ON l_orderkey = order_id WHERE l_shipdate IS NOT NULL GROUP BY ALL), days AS (SELECT date, (row_number() OVER (ORDER BY date) - 1)::INT AS t FROM (SELECT DISTINCT date FROM prices)),
r AS (SELECT segment, t, price, lag(price) OVER w AS p, lag(t) OVER w AS v FROM prices JOIN days USING (date) WINDOW w AS (PARTITION BY segment ORDER BY t)), ret AS (SELECT segment, t, CASE WHEN v = t - 1 AND p > 0 AND price > 0 THEN price / p - 1 END AS ret FROM r),
f AS (SELECT t AS u, date, 1.0::DOUBLE AS x0, sin(t * 0.7) * 0.01 AS x1, sin(t * 1.3) * 0.008 AS x2, sin(t * 2.1) * 0.006 AS x3, CASE WHEN t % 997 <> 500 THEN sin(t * 2.9) * 0.005 END AS x4, 0.0001::DOUBLE AS rf FROM days),
placed AS (SELECT e.*, d.t, d.date FROM e ASOF LEFT JOIN days d ON d.date >= e.day),
k AS (SELECT DISTINCT segment, t FROM placed WHERE t >= 210), span AS (SELECT segment, t, t + unnest(generate_series(-209, 60)) AS w FROM k),
g AS (SELECT span.segment, span.t, u, f.date, {', '.join(xs)}, ret.ret AS ret, CASE WHEN x4 IS NOT NULL THEN ret.ret - rf END AS y FROM span JOIN f ON u = w LEFT JOIN ret ON ret.segment = span.segment AND ret.t = u),
sums AS (SELECT segment, t, count(y) FILTER ({est}) AS n_obs, count(*) FILTER ({est} AND ret IS NULL) AS n_prices, count(*) FILTER ({est} AND x4 IS NULL) AS n_factors, string_agg(date::VARCHAR, ';' ORDER BY u) FILTER (u BETWEEN t AND t + 1 AND y IS NULL) AS gaps, {', '.join(sums)} FROM g GROUP BY segment, t),
{', '.join(steps)},
fit AS (SELECT segment, t, n_obs, n_prices, n_factors, gaps, na, nb, n_obs = 200 AS ok, {', '.join(f'round(m{i}5, 4) AS {c}' for i, c in enumerate(names))}, round(sqrt(greatest(yy{beta}, 0) / 195), 4) AS rmse, round(1 - greatest(yy{beta}, 0) / (yy - sy * sy / 200), 4) AS r2, round({car('a')}, 4) AS car_a, round({car('b')}, 4) AS car_b FROM {last}),
top AS (SELECT max(t) AS top FROM days)
SELECT order_id, segment, CASE WHEN t IS NULL OR t < 210 THEN 'insufficient_factor_calendar' WHEN ok THEN 'ok' ELSE 'missing_estimation_prices_or_factors' END AS status, n_obs, n_prices AS n_missing_prices, n_factors AS n_missing_factors, CASE WHEN t >= 210 THEN date_diff('day', day, placed.date) END AS day_0_lag,
CASE WHEN ok THEN na END AS car_0_1_observations, CASE WHEN ok THEN nb END AS car_2_60_observations, CASE WHEN t >= 210 THEN placed.date::VARCHAR END AS event_trading_date, (SELECT d.date::VARCHAR FROM days d WHERE placed.t >= 210 AND d.t = placed.t - 209) AS estimation_start, (SELECT d.date::VARCHAR FROM days d WHERE placed.t >= 210 AND d.t = placed.t - 10) AS estimation_end,
CASE WHEN ok IS DISTINCT FROM true THEN 'model_unavailable' WHEN na = 2 THEN 'ok' ELSE 'missing_event_prices_or_factors' END AS car_0_1_status, CASE WHEN ok IS DISTINCT FROM true THEN 'model_unavailable' WHEN nb = 59 THEN 'ok' ELSE 'missing_event_prices_or_factors' END AS car_2_60_status,
CASE WHEN ok THEN concat_ws(';', gaps, CASE WHEN t > top THEN 'day_0_outside_factor_calendar' END, CASE WHEN t + 1 > top THEN 'day_1_outside_factor_calendar' END) END AS car_0_1_missing_dates,
{', '.join(f'CASE WHEN ok THEN {c} END AS {c}' for c in [*names, 'rmse', 'r2'])}, CASE WHEN ok AND na = 2 THEN car_a END AS car_0_1, CASE WHEN ok AND nb = 59 THEN car_b END AS car_2_60 FROM placed LEFT JOIN fit USING (segment, t), top"""


STUDY = _study_sql()


def asof_history(spark, sf_dir):
    """The type of each user's last event at or before each order's day, with conflicts."""
    ev = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("since"), F.col("event_type").alias("kind"))
    probes = table(spark, sf_dir, "events").select(F.col("event_id").alias("probe"), F.pmod(F.col("user_id") * 3 + 1, F.lit(160)).alias("user_id"), F.date_sub(F.to_date("ts"), 1).alias("at"))
    out = T.asof_backward(probes, ev, key="user_id", at="at", since="since", value="kind", id_col="probe")
    return out.select("probe", "user_id", F.col("at").cast("string").alias("probe_day"), "kind", F.col("since_used").cast("string").alias("since_used"), "status")


ASOF = """WITH h AS (SELECT user_id, ts::DATE AS since, count(DISTINCT event_type) AS n, min(event_type) AS kind FROM events GROUP BY ALL), p AS (SELECT event_id AS probe, (user_id * 3 + 1) % 160 AS user_id, ts::DATE - 1 AS probe_day FROM events),
j AS (SELECT p.*, h.since, h.n, h.kind FROM p ASOF LEFT JOIN h ON p.user_id = h.user_id AND p.probe_day >= h.since) SELECT probe, user_id, probe_day::VARCHAR AS probe_day, CASE WHEN n = 1 THEN kind END AS kind, since::VARCHAR AS since_used, CASE WHEN since IS NULL THEN 'missing' WHEN n > 1 THEN 'conflict' ELSE 'matched' END AS status FROM j"""


def listing_overlap(spark, sf_dir):
    """Quarters in which each supplier ships: intervals met with a calendar of quarters."""
    spans = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.to_date(F.min("l_shipdate")).alias("a"), F.to_date(F.max("l_shipdate")).alias("b"))
    span = spans.agg(F.year(F.min("a")).alias("lo"), F.year(F.max("b")).alias("hi"))
    quarters = span.select(F.explode(F.sequence("lo", "hi")).alias("y")).select(F.explode(F.array(*[F.concat(F.col("y").cast("string"), F.lit(f"Q{k}")) for k in (1, 2, 3, 4)])).alias("quarter")).select("quarter", V.quarter_start(F.col("quarter")).alias("qa"), V.quarter_end(F.col("quarter")).alias("qb"))
    return G.overlapping(spans, quarters, on=[], left_span=("a", "b"), right_span=("qa", "qb")).groupBy("quarter").agg(F.count("*").alias("listed"))


LISTED = "WITH s AS (SELECT l_suppkey, min(l_shipdate)::DATE AS a, max(l_shipdate)::DATE AS b FROM lineitem GROUP BY 1), q AS (SELECT make_date(y, m, 1) AS qa FROM (SELECT unnest(range(year(min(l_shipdate)), year(max(l_shipdate)) + 1)) AS y FROM lineitem), (VALUES (1), (4), (7), (10)) v(m)) SELECT year(qa) || 'Q' || quarter(qa) AS quarter, count(*) AS listed FROM s JOIN q ON a <= last_day(qa + INTERVAL 2 MONTH) AND qa <= b GROUP BY 1"


def filing_windows(spark, sf_dir):
    """Each customer's quarter with an order, and the customer's orders from 60 days before it to 180 days after it."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    quarters = o.select(F.col("o_custkey").alias("issuer"), V.quarter_label(F.col("day")).alias("quarter")).distinct()
    quarters = quarters.withColumns({"opens": F.date_sub(V.quarter_start(F.col("quarter")), 60), "closes": F.date_add(V.quarter_end(F.col("quarter")), 180)})
    links = G.dates_in_windows(o, quarters, on=[("o_custkey", "issuer")], at="day", span=("opens", "closes"))
    return links.select("issuer", "quarter", "o_orderkey", F.col("day").cast("string").alias("day"), F.col("opens").cast("string").alias("opens"), F.col("closes").cast("string").alias("closes"))


WINDOWS = "WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS day FROM orders), q AS (SELECT DISTINCT o_custkey AS issuer, date_trunc('quarter', day)::DATE AS s FROM o), w AS (SELECT issuer, year(s) || 'Q' || quarter(s) AS quarter, s - 60 AS opens, last_day(s + INTERVAL 2 MONTH) + 180 AS closes FROM q) SELECT issuer, quarter, o_orderkey, day::VARCHAR AS day, opens::DATE::VARCHAR AS opens, closes::DATE::VARCHAR AS closes FROM w JOIN o ON o_custkey = issuer AND day BETWEEN opens AND closes"


def nearest_shipment(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("at"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.to_date("l_shipdate").alias("d"))
    return T.nearest_after(o.withColumn("id", F.col("o_orderkey")), li, key="o_orderkey", at="at", date="d", least=1, most=60, id_col="id").select("o_orderkey", F.col("nearest").cast("string").alias("nearest"), F.coalesce(F.datediff("nearest", "at").cast("bigint"), F.lit(-1).cast("bigint")).alias("lag"))


NEAREST = "SELECT o_orderkey, min(l_shipdate::DATE) FILTER (l_shipdate::DATE - o_orderdate::DATE BETWEEN 1 AND 60)::VARCHAR AS nearest, coalesce(min(l_shipdate::DATE - o_orderdate::DATE) FILTER (l_shipdate::DATE - o_orderdate::DATE BETWEEN 1 AND 60), -1)::BIGINT AS lag FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"


def content_duplicates(spark, sf_dir):
    d = R.duplicate_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text"), order=["doc_id"])
    return d.select("doc_id", "content_hash", F.col("copies").cast("bigint").alias("copies"), "canonical", "is_duplicate")


DUPLICATES = "WITH h AS (SELECT doc_id, CASE WHEN length(trim(text)) > 0 THEN sha256(text) END AS content_hash FROM documents) SELECT doc_id, content_hash, CASE WHEN content_hash IS NULL THEN 1 ELSE count(*) OVER w END::BIGINT AS copies, CASE WHEN content_hash IS NULL THEN doc_id ELSE min(doc_id) OVER w END AS canonical, CASE WHEN content_hash IS NULL THEN false ELSE doc_id <> min(doc_id) OVER w END AS is_duplicate FROM h WINDOW w AS (PARTITION BY content_hash)"


def chained_dedup(spark, sf_dir):
    """Documents kept by text, then by source and length class, where only kept rows register."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"), F.concat_ws("|", "source", "lang", F.floor(F.col("n_chars") / 20).cast("string")).alias("k"))
    return R.sequential_dedup(d, "h", "k", "doc_id").select("doc_id", "status")


def canonical_status(spark, sf_dir):
    """The last event of each user and type by rank of type, the most valuable of equals."""
    ranks = F.create_map(*[x for t, r in (("purchase", 0), ("signup", 1), ("click", 2), ("view", 3)) for x in (F.lit(t), F.lit(r))])
    ev = table(spark, sf_dir, "events").withColumn("r", F.coalesce(ranks[F.col("event_type")], F.lit(9)))
    return R.best_per_key(ev, ["user_id"], [F.col("r"), F.desc("value"), F.col("event_id")]).select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))


CANONICAL = "SELECT user_id, event_id, event_type, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 9 END, value DESC NULLS LAST, event_id) = 1"


def attempt_history(spark, sf_dir):
    return R.history(table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type")


HISTORY = "SELECT user_id, count(*) AS attempts, string_agg(event_type, ';' ORDER BY event_id) AS history, arg_max(event_type, event_id) AS last FROM events GROUP BY user_id"


def agreed_brand(spark, sf_dir):
    part, li = table(spark, sf_dir, "part").select("p_partkey", "p_brand"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return R.agreed_value(li.join(part, F.col("l_partkey") == F.col("p_partkey")), "l_orderkey", "p_brand", F.col("l_linenumber"))


AGREED = "SELECT l_orderkey, arg_min(p_brand, (l_linenumber, p_brand)) AS p_brand, count(*) AS sources, count(DISTINCT p_brand) > 1 AS conflict FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey"


def reconciliation(spark, sf_dir):
    expected = table(spark, sf_dir, "orders").where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("k"))
    return R.reconciled(expected, table(spark, sf_dir, "lineitem").where("l_orderkey % 5 > 0").select(F.col("l_orderkey").alias("k")), ["k"])


RECONCILED = "WITH e AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderkey % 3 > 0), f AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey % 5 > 0) SELECT CASE WHEN f.k IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'unexpected' ELSE 'matched' END AS state, count(*) AS n FROM e FULL JOIN f ON e.k = f.k GROUP BY 1"


def table_difference(spark, sf_dir):
    left = table(spark, sf_dir, "orders").where("o_orderkey % 11 > 0").select("o_orderkey", "o_totalprice", "o_orderstatus")
    moved = F.when(F.col("o_orderkey") % 10 == 0, F.col("o_totalprice") * 1.001).otherwise(F.col("o_totalprice") + 1e-9)
    right = table(spark, sf_dir, "orders").where("o_orderkey % 13 > 0").select("o_orderkey", moved.alias("o_totalprice"), "o_orderstatus")
    return R.table_diff(left, right, "o_orderkey", ["o_totalprice"], atol=1e-6, rtol=1e-6)


DIFFERENCE = "WITH l AS (SELECT o_orderkey, o_totalprice AS x FROM orders WHERE o_orderkey % 11 > 0), r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice * 1.001 ELSE o_totalprice + 1e-9 END AS y FROM orders WHERE o_orderkey % 13 > 0) SELECT 'o_totalprice' AS \"column\", count(*) FILTER (r.o_orderkey IS NULL) AS only_left, count(*) FILTER (l.o_orderkey IS NULL) AS only_right, count(*) FILTER (abs(x - y) > 1e-6 + 1e-6 * abs(y)) AS different FROM l FULL JOIN r ON l.o_orderkey = r.o_orderkey"


def row_invariants(spark, sf_dir):
    return R.invariants(table(spark, sf_dir, "lineitem"), {"discount_at_most_5_percent": F.col("l_discount") <= 0.05, "positive_quantity": F.col("l_quantity") > 0, "known_flag": F.col("l_returnflag").isin("A", "N", "R")})


INVARIANTS = " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) FILTER (NOT coalesce({c}, false)) = 0 AS passed, count(*) FILTER (NOT coalesce({c}, false)) AS broken FROM lineitem" for n, c in (("discount_at_most_5_percent", "l_discount <= 0.05"), ("positive_quantity", "l_quantity > 0"), ("known_flag", "l_returnflag IN ('A', 'N', 'R')")))


def mapping_check(spark, sf_dir):
    return R.bijective(table(spark, sf_dir, "part"), "p_brand", "p_type")


MAPPING = "SELECT 'p_brand->p_type' AS direction, count(*) FILTER (n > 1) AS many FROM (SELECT p_brand, count(DISTINCT p_type) AS n FROM part GROUP BY 1) UNION ALL SELECT 'p_type->p_brand', count(*) FILTER (n > 1) FROM (SELECT p_type, count(DISTINCT p_brand) AS n FROM part GROUP BY 1)"


def stratified_draw(spark, sf_dir):
    return S.stratified_sample(calls(spark, sf_dir).select("id", "stratum"), "stratum", "id", 101, salt="pilot").select("stratum", "id", F.col("place").cast("bigint").alias("place"), F.round("design_weight", 9).alias("design_weight"))


DRAW = f"""WITH {CALLS}, z AS (SELECT stratum, count(*) AS size FROM calls GROUP BY 1), x AS (SELECT *, size * 101 / sum(size) OVER () AS x FROM z), b AS (SELECT *, floor(x) AS f, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, stratum) AS r, 101 - sum(floor(x)) OVER () AS l FROM x),
q AS (SELECT stratum, size, f + (r <= l)::INT AS quota FROM b), p AS (SELECT id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY sha256('pilot|' || id), id) AS place FROM calls) SELECT stratum, id, place::BIGINT AS place, round(size / quota, 9) AS design_weight FROM p JOIN q USING (stratum) WHERE place <= quota"""


def reservoir_draw(spark, sf_dir):
    """Fifty lines of each return flag by hash, with how many the flag has."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line"))
    out = S.reservoir(li, ["l_returnflag"], "line", 50, salt="pool")
    return out.select("l_returnflag", "line", F.col("place").cast("bigint").alias("place"), "seen")


RESERVOIR = "SELECT l_returnflag, line, row_number() OVER (PARTITION BY l_returnflag ORDER BY sha256('pool|' || line), line) AS place, count(*) OVER (PARTITION BY l_returnflag) AS seen FROM (SELECT l_returnflag, l_orderkey || '-' || l_linenumber AS line FROM lineitem) QUALIFY place <= 50"


def balanced_years(spark, sf_dir):
    """Orders, two in five of all, as evenly over the years as these allow: years that have fewer give all."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    return S.balanced_sample(o, "year", "o_orderkey", o.count() * 2 // 5, salt="even")


BALANCED = """WITH RECURSIVE o AS (SELECT o_orderkey, year(o_orderdate)::INT AS year FROM orders), n AS (SELECT count(*) * 2 // 5 AS total FROM o), s AS (SELECT year, count(*) AS size FROM o GROUP BY year),
fill(round, level, spare) AS (SELECT 0, 0::BIGINT, (SELECT total FROM n) UNION ALL SELECT round + 1, level + greatest(spare // (SELECT count(*) FROM s WHERE size > level), 1), (SELECT total FROM n) - (SELECT sum(least(size, level + greatest(spare // (SELECT count(*) FROM s WHERE size > level), 1))) FROM s)::BIGINT FROM fill WHERE spare >= (SELECT count(*) FROM s WHERE size > level) AND round < 1000),
f AS (SELECT * FROM fill ORDER BY round DESC LIMIT 1), q AS (SELECT year, least(size, level) + CASE WHEN size > level AND row_number() OVER (PARTITION BY size > level ORDER BY year) <= spare THEN 1 ELSE 0 END AS quota FROM s, f)
SELECT o_orderkey, year, quota::BIGINT AS quota, row_number() OVER (PARTITION BY year ORDER BY sha256('even|' || o_orderkey), o_orderkey) AS place FROM o JOIN q USING (year) QUALIFY place <= quota"""

#: Buckets of parts by words of their type, the first that fits.
KINDS = {"rings": ["RING"], "sized": ["small", "MEDIUM", "Large"], "offers": ["promo", "Economy"]}


def bucket_quotas(spark, sf_dir):
    """The first forty parts of each kind."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name")
    return S.filled_buckets(p, S.keyword_bucket(["p_type", "p_name"], KINDS), "p_partkey", 40).select("p_partkey", "bucket", F.col("place").cast("bigint").alias("place"))


_KIND = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(t, '{w.lower()}')" for w in words) + f" THEN '{name}'" for name, words in KINDS.items()) + " END"
BUCKETS = f"SELECT p_partkey, bucket, row_number() OVER (PARTITION BY bucket ORDER BY p_partkey) AS place FROM (SELECT p_partkey, {_KIND} AS bucket FROM (SELECT p_partkey, lower(p_type || ' ' || p_name) AS t FROM part)) WHERE bucket IS NOT NULL QUALIFY place <= 40"


def size_proxies(spark, sf_dir):
    """Of each segment the customers nearest to the ranks 0, 10, 100 and 1000 by balance."""
    return S.nearest_ranks(table(spark, sf_dir, "customer"), "c_mktsegment", [-F.col("c_acctbal"), F.col("c_custkey")], "c_custkey", [0, 10, 100, 1000])


PROXIES = "WITH r AS (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) - 1 AS rank FROM customer) SELECT c_mktsegment, target::INT AS target, min(rank) AS rank, arg_min(c_custkey, (abs(rank - target), rank)) AS c_custkey FROM (SELECT *, abs(rank - target) AS gap, min(abs(rank - target)) OVER (PARTITION BY c_mktsegment, target) AS least FROM r, (VALUES (0), (10), (100), (1000)) t(target)) WHERE gap = least GROUP BY c_mktsegment, target"


def first_by_hash(spark, sf_dir):
    return S.first_per_stratum(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_custkey", 3, salt="first").select("c_mktsegment", "c_custkey", F.col("place").cast("bigint").alias("place"))


FIRST = "SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('first|' || c_custkey), c_custkey) AS place FROM customer QUALIFY place <= 3"


def bernoulli_draw(spark, sf_dir):
    return S.bernoulli(table(spark, sf_dir, "orders"), "o_orderkey", 100_000, salt="tenth").select("o_orderkey")


BERNOULLI = "SELECT o_orderkey FROM orders WHERE ('0x' || substr(sha256('tenth|' || o_orderkey), 1, 8))::BIGINT % 1000000 < 100000"


def regressions(spark, sf_dir):
    """Outcome on scores: pooled, within strata, and within strata and quarters; clustered by customer."""
    c = calls(spark, sf_dir).withColumn("one", F.lit(1.0)).withColumn("y", F.col("outcome")).withColumn("a", F.col("score") / 100).withColumn("b", F.col("second") / 10)
    rows = []
    for model, df, xs, absorbed in (("pooled", c, ["one", "a", "b"], 0), ("within", I.demeaned(c, ["y", "a", "b"], ["stratum"]), ["a", "b"], 5), ("two_way", I.demeaned(c, ["y", "a", "b"], ["stratum", "period"]), ["a", "b"], 4 + c.select("period").distinct().count())):
        fit = I.clustered_ols(df, "y", xs, "cluster", absorbed=absorbed)
        rows += [(model, x, round(v["beta"], 6), round(v["se"], 6)) for x, v in fit.items() if x != "one"]
    return spark.createDataFrame(rows, "model string, term string, beta double, se double")


def leverage(spark, sf_dir):
    """Leverage, residual and Cook's distance of every order in the pooled fit of its outcome."""
    c = calls(spark, sf_dir).withColumn("one", F.lit(1.0)).withColumn("x", F.col("score") / 100)
    rows, _ = I.influence(c, "outcome", ["one", "x"], "cluster")
    return rows.select("id", F.round("residual", 6).alias("residual"), F.round("leverage", 9).alias("leverage"), F.round("cooks", 9).alias("cooks"))


_POOLED = f"{CALLS}, m AS (SELECT count(*) AS n, avg(score / 100) AS mx, sum(score * score / 10000) - count(*) * avg(score / 100) * avg(score / 100) AS sxx, covar_pop(score / 100, outcome) / var_pop(score / 100) AS b, avg(outcome) AS my FROM calls), e AS (SELECT id, cluster, n, sxx, score / 100 - mx AS d, outcome - my - b * (score / 100 - mx) AS r, 1.0 / n + (score / 100 - mx) * (score / 100 - mx) / sxx AS h FROM calls, m)"
LEVERAGE = f"WITH {_POOLED}, q AS (SELECT sum(r * r) / (count(*) - 2) AS mse FROM e) SELECT id, round(r, 6) AS residual, round(h, 9) AS leverage, round(r * r / (2 * mse) * h / ((1 - h) * (1 - h)), 9) AS cooks FROM e, q"


def cluster_influence(spark, sf_dir):
    """The first-order change of the pooled slope that each customer's orders make."""
    c = calls(spark, sf_dir).withColumn("one", F.lit(1.0)).withColumn("x", F.col("score") / 100)
    return I.influence(c, "outcome", ["one", "x"], "cluster")[1].select("cluster", F.round("d_x", 9).alias("slope"))


INFLUENCE = f"WITH {_POOLED} SELECT cluster, round(sum(r * d / sxx), 9) AS slope FROM e GROUP BY cluster"


def fiscal_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    label = V.quarter_label(F.col("d"))
    text = lambda c, n: c.cast("string").alias(n)
    return o.select("o_orderkey", label.alias("quarter"), text(V.quarter_start(label), "starts"), text(V.quarter_end(label), "ends"), text(F.add_months("d", -3), "back"), text(V.fiscal_period_end(F.year("d"), F.quarter("d"), F.lit(5)), "fiscal_end"), V.in_period(label, "1993Q1", "1996Q4").alias("in_period"), F.weekday("d").cast("int").alias("weekday"))


FISCAL = """SELECT o_orderkey, year(d) || 'Q' || quarter(d) AS quarter, date_trunc('quarter', d)::DATE::VARCHAR AS starts, last_day(date_trunc('quarter', d)::DATE + INTERVAL 2 MONTH)::DATE::VARCHAR AS ends, (d - INTERVAL 3 MONTH)::DATE::VARCHAR AS back,
    last_day(make_date(year(d), 5, 1) + to_months((3 * (quarter(d) - 4))::INT))::DATE::VARCHAR AS fiscal_end, (year(d) || 'Q' || quarter(d)) BETWEEN '1993Q1' AND '1996Q4' AS in_period, (isodow(d) - 1)::INT AS weekday FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)"""


def surrogate_ids(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    code = (F.pmod(F.col("p_partkey") * 7, F.lit(100)) * 100 + F.col("p_size")).cast("int")
    return p.select("p_partkey", V.surrogate_id("AV", F.col("p_brand"), F.col("p_name")).alias("surrogate"), V.padded(F.col("p_size").cast("string"), 4).alias("code"), V.sic_division(code).alias("division"))


_DIV = "CASE " + " ".join(f"WHEN g BETWEEN {a} AND {b} THEN '{n}'" for a, b, n in V.DIVISIONS) + " END"
SURROGATE = f"SELECT p_partkey, 'AV' || upper(substr(sha256(p_brand || '|' || p_name), 1, 16)) AS surrogate, lpad(p_size::VARCHAR, 4, '0') AS code, {_DIV} AS division FROM (SELECT *, (((p_partkey * 7) % 100) * 100 + p_size) // 100 AS g FROM part)"


def precision_by_signal(spark, sf_dir):
    """Share of good labels among documents of each language and length class."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 3000, "middle").otherwise("long").alias("size"))
    return d.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("lang", "size").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.round(F.avg("quality"), 9).alias("precision"), F.round(F.sum("quality") / F.sum(F.count("*")).over(Window.partitionBy("lang")), 9).alias("share_of_lang"))


PRECISION = "WITH d AS (SELECT doc_id, lang, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 3000 THEN 'middle' ELSE 'long' END AS size FROM documents), g AS (SELECT lang, size, count(*) AS n, count(*) FILTER (quality = 1) AS good, avg(quality) AS p, sum(quality) AS q FROM d JOIN labels USING (doc_id) GROUP BY ALL) SELECT lang, size, n, good, round(p, 9) AS precision, round(q / sum(n) OVER (PARTITION BY lang), 9) AS share_of_lang FROM g"

_HERE = globals()
QUERIES = {n: _HERE[n] for n in "reservoir_draw balanced_years bucket_quotas size_proxies rank_correlations filing_windows winsorized_scores hash_quintiles fractional_cells portfolio_means portfolio_covariance portfolio_contrasts sector_ranks zero_apart_bins gate_funnel exclusion_reasons coverage_rollups status_pivot describe_groups daily_returns next_trading_day event_windows asof_history listing_overlap nearest_shipment content_duplicates chained_dedup canonical_status attempt_history agreed_brand reconciliation table_difference row_invariants mapping_check stratified_draw first_by_hash bernoulli_draw regressions leverage cluster_influence fiscal_dates surrogate_ids precision_by_signal".split()}
ORACLES = {
    "reservoir_draw": RESERVOIR, "balanced_years": BALANCED, "bucket_quotas": BUCKETS, "size_proxies": PROXIES, "rank_correlations": RANK_CORRELATIONS, "filing_windows": WINDOWS, "winsorized_scores": WINSOR, "hash_quintiles": QUINTILES, "fractional_cells": CELLS, "portfolio_means": MEANS, "portfolio_covariance": COVARIANCE, "portfolio_contrasts": CONTRASTS, "sector_ranks": RANKS, "zero_apart_bins": BINS, "gate_funnel": FUNNEL,
    "exclusion_reasons": REASONS, "coverage_rollups": ROLLUPS, "status_pivot": PIVOT, "describe_groups": DESCRIBE, "daily_returns": RETURNS, "event_windows": STUDY, "next_trading_day": NEXT_DAY, "asof_history": ASOF, "listing_overlap": LISTED, "nearest_shipment": NEAREST,
    "content_duplicates": DUPLICATES, "canonical_status": CANONICAL, "attempt_history": HISTORY, "agreed_brand": AGREED, "reconciliation": RECONCILED, "table_difference": DIFFERENCE, "row_invariants": INVARIANTS, "mapping_check": MAPPING,
    "stratified_draw": DRAW, "first_by_hash": FIRST, "bernoulli_draw": BERNOULLI, "leverage": LEVERAGE, "cluster_influence": INFLUENCE, "fiscal_dates": FISCAL, "surrogate_ids": SURROGATE, "precision_by_signal": PRECISION,
}

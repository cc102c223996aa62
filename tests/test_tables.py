import datetime as dt

import numpy as np
import pandas as pd
import pytest
from lumenfold.functions import values as V
from lumenfold.operators import allocation as A
from lumenfold.operators import inference as I
from lumenfold.operators import records as R
from lumenfold.operators import returns as RT
from lumenfold.operators import sampling as S
from lumenfold.operators import temporal as T
from pyspark.sql import functions as F


def members(spark, values, weights=None):
    rows = [(i, float(v), float(w)) for i, (v, w) in enumerate(zip(values, weights or [1.0] * len(values), strict=True))]
    df = spark.createDataFrame(rows, "id int, v double, m double").withColumn("all", F.lit(1))
    got = {}
    for r in A.fractional_membership(df, "v", by=["all"], name="q", mass="m").collect():
        got[r.id, r.q] = r.weight
    return got


def test_fractional_ties(spark):
    got = members(spark, [0, 0, 0, 1, 2])
    assert all(got[i, q] == pytest.approx(1 / 3) for i in range(3) for q in (1, 2, 3)) and got[3, 4] == got[4, 5] == pytest.approx(1) and len(got) == 11
    weighted = members(spark, [0, 0, 1], [0.5, 0.5, 1])
    assert [sum(w for (_, q), w in weighted.items() if q == k) for k in range(1, 6)] == pytest.approx([0.4] * 5)
    assert members(spark, [0], [0.37]) == {(0, q): pytest.approx(0.074) for q in range(1, 6)}


def test_fractional_membership_conserves(spark):
    rng = np.random.default_rng(3)
    w = rng.uniform(0.01, 2, 101)
    got = members(spark, rng.integers(0, 8, 101).tolist(), w.tolist())
    assert [sum(x for (i, _), x in got.items() if i == k) for k in range(101)] == pytest.approx(w.tolist())
    assert [sum(x for (_, q), x in got.items() if q == k) for k in range(1, 6)] == pytest.approx([w.sum() / 5] * 5)


def test_quintiles_are_not_ntile(spark):
    df = spark.createDataFrame([(i, 0.0) for i in range(13)], "id int, v double").withColumn("all", F.lit(1))
    got = A.equal_quintiles(df, "v", "id", "q", by=["all"]).groupBy("q").count().orderBy("q").collect()
    assert [r["count"] for r in got] == [3, 3, 2, 3, 2]


def test_clustered_mean(spark):
    df = spark.createDataFrame([(1.0, "a"), (1.0, "a"), (3.0, "b"), (3.0, "b"), (None, "c")], "y double, c string")
    r = I.clustered_means(df, "y", "c", by=[]).first()
    assert (r.mean, r.se, r.n, r.clusters) == (2.0, 1.0, 4, 2)


def test_regression_equals_dummies(spark):
    rng = np.random.default_rng(812)
    n = 160
    g, c = rng.integers(0, 4, n), rng.integers(0, 10, n)
    x = rng.normal(size=(n, 2))
    y = x @ [0.5, -1.0] + g + rng.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "a": x[:, 0], "b": x[:, 1], "g": g, "c": c}))
    fit = I.clustered_ols(I.demeaned(df, ["y", "a", "b"], ["g"]), "y", ["a", "b"], "c", absorbed=4)
    full = np.column_stack([x, *(g == k for k in range(4))]).astype(float)
    beta = np.linalg.lstsq(full, y, rcond=None)[0]
    e, inverse = y - full @ beta, np.linalg.inv(full.T @ full)
    s = np.array([full[c == k].T @ e[c == k] for k in range(10)])
    v = 10 / 9 * (n - 1) / (n - 6) * inverse @ s.T @ s @ inverse
    assert [fit["a"]["beta"], fit["b"]["beta"]] == pytest.approx(beta[:2].tolist())
    assert [fit["a"]["se"], fit["b"]["se"]] == pytest.approx(np.sqrt(np.diag(v))[:2].tolist())
    assert I.inflation(df, ["a", "b"])["a"] == pytest.approx(1 / (1 - np.corrcoef(x.T)[0, 1] ** 2))


def test_two_way_effects_on_a_chain(spark):
    """A weakly linked panel, where alternating means would need thousands of rounds."""
    rng = np.random.default_rng(97)
    g, h = np.repeat(np.arange(40), 2), np.concatenate([[k, k + 1] for k in range(40)])
    y, x = rng.normal(size=(2, 80))
    df = spark.createDataFrame(pd.DataFrame({"i": range(80), "y": y, "x": x, "g": g, "h": h}))
    dummies = np.column_stack([*(g == k for k in range(40)), *(h == k for k in range(41))]).astype(float)
    want = y - dummies @ np.linalg.lstsq(dummies, y, rcond=None)[0]
    got = [r.y for r in I.demeaned(df, ["y", "x"], ["g", "h"]).orderBy("i").collect()]
    assert got == pytest.approx(want.tolist(), abs=1e-8)


def test_alternating_means_settle_or_fail(spark):
    df = spark.createDataFrame([(k, float(k * k % 7), k % 3, None if k % 2 else 1) for k in range(12)], "i int, y double, g int, h int")
    direct = [r.y for r in I.demeaned(df, ["y"], ["g", "h"]).orderBy("i").collect()]
    assert [r.y for r in I.demeaned(df, ["y"], ["g", "h"], direct=1).orderBy("i").collect()] == pytest.approx(direct, abs=1e-9)
    with pytest.raises(ArithmeticError):
        I.demeaned(df, ["y"], ["g", "h"], direct=1, tolerance=0.0, rounds=1)


def test_influence(spark):
    rng = np.random.default_rng(5)
    x, y, c = rng.normal(size=30), rng.normal(size=30), rng.integers(0, 6, 30)
    x[0], one = 9.0, np.ones(30)
    rows, moves = I.influence(spark.createDataFrame(pd.DataFrame({"i": range(30), "one": one, "x": x, "y": y, "c": c})), "y", ["one", "x"], "c")
    full = np.column_stack([one, x])
    inverse = np.linalg.inv(full.T @ full)
    h, e = np.einsum("ij,jk,ik->i", full, inverse, full), y - full @ inverse @ full.T @ y
    got = rows.orderBy("i").collect()
    assert [r.leverage for r in got] == pytest.approx(h.tolist())
    assert [r.cooks for r in got] == pytest.approx((e**2 / (2 * (e @ e) / 28) * h / (1 - h) ** 2).tolist())
    assert {r.c: r.d_x for r in moves.collect()} == pytest.approx({int(k): float(((full * e[:, None])[c == k].sum(0) @ inverse)[1]) for k in set(c)})


def test_student_t():
    assert V.student_t_sf(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert V.student_t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)


def market(spark, drop=None, gap=None):
    rng = np.random.default_rng(731)
    days = pd.bdate_range("2008-01-01", periods=350)
    f = pd.DataFrame(rng.normal(0, 0.008, (350, 4)), columns=RT.FACTORS).assign(rf=0.0001, t=range(350))
    r = f["rf"] + 0.0003 + f[RT.FACTORS].to_numpy() @ [0.9, 0.2, -0.1, 0.15]
    i = 250
    r[i] += 0.01
    r[i + 1] -= 0.005
    r[i + 2 : i + 61] += 0.0002
    price = 100 * np.cumprod(1 + r)
    p = pd.DataFrame({"k": "x", "date": days.date, "price": price})
    if drop is not None:
        p = p.drop(i + drop)
    if gap is not None:
        f.loc[i + gap, "mom"] = np.nan
    cal = spark.createDataFrame(pd.DataFrame({"date": days.date}))
    cal = T.calendar(cal, "date")
    events = T.asof_forward(spark.createDataFrame([(1, "x", days[i].date())], "event_id long, k string, day date"), cal, at="day")
    factors = spark.createDataFrame(f).withColumn("mom", F.when(~F.isnan("mom"), F.col("mom")))
    ret = T.daily_returns(spark.createDataFrame(p), cal, key="k", date="date", price="price")
    return RT.event_study(events, ret, factors, cal, key="k", at="day").first()


def test_event_study_recovers_the_bump(spark):
    r = market(spark)
    assert (r.status, r.n_obs, r.matrix_rank) == ("ok", 200, 5)
    assert r.car_0_1 == pytest.approx(0.005, abs=1e-12) and r.car_2_60 == pytest.approx(59 * 0.0002, abs=1e-12)
    r = market(spark, drop=-100)
    assert (r.status, r.n_obs, r.car_0_1) == ("missing_estimation_prices_or_factors", 198, None)
    r = market(spark, gap=2)
    assert r.car_0_1 == pytest.approx(0.005, abs=1e-12) and r.car_2_60 is None


def test_event_study_statuses_equal_least_squares(spark):
    """Nulls, an end of the calendar, gaps, repeated events and clashing names, against numpy one by one."""
    rng, n = np.random.default_rng(7), 330
    days = pd.bdate_range("2010-01-01", periods=n)
    f = pd.DataFrame(rng.normal(0, 0.01, (n, 4)), columns=RT.FACTORS).assign(rf=0.0001, t=range(n))
    f.loc[320, "mom"] = np.nan
    ret = {"a": rng.normal(0, 0.02, n), "b": rng.normal(0, 0.02, n)}
    ret["b"][150] = np.nan
    rows = [(k, t, None if np.isnan(v) else float(v)) for k, r in ret.items() for t, v in enumerate(r)]
    cal = T.calendar(spark.createDataFrame(pd.DataFrame({"date": days.date})), "date")
    wanted = [("a", 215), ("a", 250), ("a", 250), ("a", 300), ("a", 329), ("b", 250), ("c", 250), (None, 250), ("a", 100), ("a", None)]
    events = [(i, k, None if t is None else days[t].date(), t, "own") for i, (k, t) in enumerate(wanted)] + [(99, "a", dt.date(2030, 1, 1), None, "own")]
    events = spark.createDataFrame(events, "event_id long, k string, day date, t int, rank string")
    out = RT.event_study(events, spark.createDataFrame(rows, "k string, t int, ret double"), spark.createDataFrame(f), cal, key="k", at="day")
    got = {r.event_id: r for r in out.collect()}
    assert len(got) == 11 and got[99].status == "insufficient_factor_calendar" and {r["rank"] for r in got.values()} == {"own"}
    x, whole = np.column_stack([np.ones(n), f[RT.FACTORS]]), np.isfinite(f["mom"].to_numpy())
    for i, (k, t) in enumerate(wanted):
        r = got[i]
        if t is None or t < 210:
            assert r.status == ("unconfirmed_call_date" if t is None else "insufficient_factor_calendar") and r.n_obs is None
            continue
        y = (ret.get(k, np.full(n, np.nan)) - 0.0001)[: n]
        est = slice(t - 209, t - 9)
        good = np.isfinite(y) & whole
        assert r.n_obs == good[est].sum() and r.n_missing_prices == (~np.isfinite(y[est])).sum()
        if not good[est].all():
            assert r.status == "missing_estimation_prices_or_factors" and r.car_0_1_status == "model_unavailable"
            assert r.missing_estimation_dates == ";".join(str(days[j].date()) for j in range(t - 209, t - 9) if not good[j])
            continue
        beta, left, _, sizes = np.linalg.lstsq(x[est], y[est], rcond=None)
        assert r.status == "ok" and r.condition == pytest.approx(sizes[0] / sizes[-1]) and r.rmse == pytest.approx(np.sqrt(left[0] / 195))
        assert [r[c] for c in RT.COEFFICIENTS] == pytest.approx(list(beta), abs=1e-10)
        for name, (a, b) in RT.AFTER.items():
            missing = [f"day_{j}_outside_factor_calendar" if t + j >= n else str(days[t + j].date()) for j in range(a, b + 1) if t + j >= n or not good[t + j]]
            assert sorted(r[f"{name}_missing_dates"].split(";")) == sorted(missing or [""])
            assert r[f"{name}_observations"] == b - a + 1 - len(missing)
            if missing:
                assert r[name] is None and r[f"{name}_status"] == "missing_event_prices_or_factors"
            else:
                assert r[name] == pytest.approx((y - x @ beta)[t + a : t + b + 1].sum(), abs=1e-10)
    flat = spark.createDataFrame(f.assign(mom=f["smb"]))
    assert RT.event_study(events.where("event_id = 1"), spark.createDataFrame(rows, "k string, t int, ret double"), flat, cal, key="k", at="day").first().status == "rank_deficient"
    assert RT.event_study(events.limit(0), spark.createDataFrame(rows, "k string, t int, ret double"), flat, cal, key="k", at="day").count() == 0


def test_asof_with_conflicts(spark):
    day = lambda d: dt.date(2020, 1, d)
    history = spark.createDataFrame([("a", day(1), "x"), ("a", day(5), "y"), ("a", day(5), "z"), ("a", day(9), "w")], "k string, since date, v string")
    probes = spark.createDataFrame([(1, "a", day(4)), (2, "a", day(5)), (3, "a", day(8)), (4, "a", day(9)), (5, "b", day(9)), (6, "a", dt.date(2019, 1, 1))], "id long, k string, at date")
    got = {r.id: (r.v, r.status) for r in T.asof_backward(probes, history, key="k", at="at", since="since", value="v", id_col="id").collect()}
    assert got == {1: ("x", "matched"), 2: (None, "conflict"), 3: (None, "conflict"), 4: ("w", "matched"), 5: (None, "missing"), 6: (None, "missing")}


def test_sequential_dedup_equals_a_pass(spark):
    rng = np.random.default_rng(5)
    rows = [(i, f"h{rng.integers(0, 25)}", f"k{rng.integers(0, 25)}") for i in range(80)]
    got = {r.i: r.status for r in R.sequential_dedup(spark.createDataFrame(rows, "i long, h string, k string"), "h", "k", "i").collect()}
    hs, ks, wanted = set(), set(), {}
    for i, h, k in rows:
        wanted[i] = "dup_first" if h in hs else "dup_second" if k in ks else "kept"
        if wanted[i] == "kept":
            hs.add(h)
            ks.add(k)
    assert got == wanted


def test_quotas_and_contract(spark):
    df = spark.createDataFrame([("abc"[0 if i < 70 else 1 if i < 90 else 2], i) for i in range(100)], "s string, i int")
    assert [r.quota for r in S.quotas(df, "s", 20).orderBy("s").collect()] == [14, 4, 2]
    assert R.checked(df, columns=["s"], keys=["i"], rows=100) is df
    for broken in ({"columns": ["x"]}, {"keys": ["s"]}, {"rows": 5}):
        with pytest.raises(R.ContractError):
            R.checked(df, **broken)


def test_dates(spark):
    df = spark.createDataFrame([(dt.date(2012, 5, 31),)], "d date")
    r = df.select(F.add_months("d", -3).alias("a"), V.fiscal_period_end(F.lit(2012), F.lit(3), F.lit(5)).alias("b"), V.fiscal_period_end(F.lit(2012), F.lit(1), F.lit(5)).alias("c"), V.any_date(F.lit("20120131")).alias("e"), V.any_date(F.lit("junk")).alias("f")).first()
    assert tuple(r) == (dt.date(2012, 2, 29), dt.date(2012, 2, 29), dt.date(2011, 8, 31), dt.date(2012, 1, 31), None)

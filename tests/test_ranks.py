"""Positions, ranks and percentiles over ranges against numpy and pandas."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import allocation as A
from lumenfold.operators import ranks as K


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    values = [float(x) for x in rng.choice([0.0, 1.0, -2.5, 1e308, -1e308, 7.0], 300)] + [float(x) for x in rng.normal(size=300)] + [None, math.nan, 5.0]
    return [(i, "a" if i % 3 else None if i % 2 else "b", v, float(i % 7)) for i, v in enumerate(values)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "id int, g string, v double, w double").repartition(7)


def good(rows, g):
    return sorted(r[2] for r in rows if r[1] == g and r[2] is not None and not math.isnan(r[2]))


def test_percentiles_by_group_with_nulls_nan_and_huge_values(rows, table):
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: list(r.p) for r in K.percentiles(table, "v", shares, by=["g"], name="p").collect()}
    for g in ("a", "b", None):
        own = good(rows, g)
        for s, x in zip(shares, got[g], strict=True):
            k = s * (len(own) - 1)
            lo, hi = own[math.floor(k)], own[math.ceil(k)]
            want = lo + (hi - lo) * (k - math.floor(k))
            assert x == want or math.isclose(x, want, rel_tol=1e-12)
    assert K.percentiles(table.where("g = 'none'"), "v", [0.5]).count() == 0
    assert K.percentiles(table.select(F.lit(4.0).alias("v")), "v", [0.3]).first()[0] == [4.0]


def test_positions_are_those_of_a_window(table, rows):
    got = K.positions(table, ["g"], [F.col("w").desc(), F.col("id").asc()], "at").collect()
    for g in ("a", "b", None):
        want = [r[0] for r in sorted((r for r in rows if r[1] == g), key=lambda r: (-r[3], r[0]))]
        own = sorted((r for r in got if r.g == g), key=lambda r: r.at)
        assert [r.id for r in own] == want and [r.at for r in own] == list(range(len(want))) and {r.at_of for r in own} == {len(want)}
    assert K.positions(table.limit(0), [], [F.col("id")], "at").count() == 0


def test_ranks_and_spearman_equal_pandas(table, rows):
    frame = pd.DataFrame(rows, columns=["id", "g", "v", "w"])
    own = frame[frame.g == "a"].dropna(subset=["v"])
    got = {r.id: (r.place, r.place_of) for r in A.competition_rank(table, "v", "place", by=["g"]).where("g = 'a'").collect()}
    want = own.v.rank(method="min", ascending=False)
    assert {i: p for i, (p, _) in got.items() if p is not None} == {int(i): int(p) for i, p in zip(own.id, want, strict=True)}
    assert all(n == (0 if p is None else len(own)) for p, n in got.values())
    assert math.isclose(K.spearman(table.where("g = 'a'"), "v", "w").first().spearman, own.v.rank().corr(own.w.rank()), abs_tol=1e-12)
    assert K.spearman(table.withColumn("one", F.lit(1.0)), "v", "one").first().spearman is None

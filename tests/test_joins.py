import pytest
from lumenfold.operators import joins as J
from lumenfold.operators.records import ContractError
from pyspark.sql import functions as F


def test_promises_statuses_and_clashing_names(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "k int, v string")
    right = spark.createDataFrame([(1, "x", 5), (3, "y", 6)], "k int, v string, n int")
    got = {(r.k, r.v, r.v_right, r.n, r.met) for r in J.contract_join(left, right, ["k"], status="met").collect()}
    assert got == {(1, "a", "x", 5, "matched"), (2, "b", None, None, "missing"), (2, "c", None, None, "missing"), (None, "d", None, None, "missing")}
    with pytest.raises(ContractError):
        J.contract_join(left, right, ["k"], promise="one_to_one")
    with pytest.raises(ContractError):
        J.contract_join(left, left, ["k"])
    with pytest.raises(ContractError):
        J.contract_join(left, right, ["k"], complete=True)
    assert sorted((r.k is None, r.k, r.v) for r in J.unmatched(left, right, ["k"]).collect()) == [(False, 2, "b"), (False, 2, "c"), (True, None, "d")]
    assert J.contract_join(left.limit(0), right, ["k"], complete=True).count() == 0


def test_ends_retention_and_bins(spark):
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(7)] + [(9, None)], "k int, v double")
    got = [(r.end, r.place, r.k) for r in J.head_and_tail(df.where("v is not null"), [F.col("v"), F.col("k")], 2).orderBy("end", "place").collect()]
    assert got == [("head", 1, 0), ("head", 2, 3), ("tail", 1, 5), ("tail", 2, 2)]
    after = df.withColumn("v", -F.col("v"))
    assert tuple(J.retention(df.na.drop(), after.na.drop(), "k", "v", 3).first()) == (3, 0, 0.0)
    bins = {r.k: r.bin for r in J.quantile_bins(df, "v", "bin", bins=10).collect()}
    assert bins[9] is None and bins[0] == bins[3] == bins[6] and bins[1] == bins[4] and bins[2] == bins[5] and len(set(bins.values())) == 4 - (bins[0] == bins[1])

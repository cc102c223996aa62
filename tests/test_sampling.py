"""Reservoirs, even quotas, buckets and nearest ranks against plain Python."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import sampling as S


def digest(salt, key):
    return hashlib.sha256(f"{salt}|{key}".encode()).hexdigest()


def test_reservoir_is_the_same_for_any_partitions_and_counts_all(spark):
    rows = [(i, "a" if i % 3 else None) for i in range(500)]
    want = {(g, i, p, sum(x == g for _, x in rows)) for g in ("a", None) for p, i in enumerate(sorted((i for i, x in rows if x == g), key=lambda i: (digest("s", i), i))[:7], 1)}
    for parts in (1, 13):
        df = spark.createDataFrame(rows, "i int, g string").repartition(parts)
        assert {(r.g, r.i, r.place, r.seen) for r in S.reservoir(df, ["g"], "i", 7, salt="s").collect()} == want
    assert S.reservoir(df.limit(0), ["g"], "i", 7, salt="s").count() == 0


@pytest.mark.parametrize("total", [0, 1, 10, 11, 37, 60, 89, 500])
def test_even_quotas_are_the_fixed_point_of_topping_up(spark, total):
    sizes = {"a": 3, "b": 50, "c": 9, "d": 9, "e": 18}
    quota, left = dict.fromkeys(sizes, 0), min(total, sum(sizes.values()))
    while left:  # one each in turn
        for g in sorted(sizes):
            if left and quota[g] < sizes[g]:
                quota[g] += 1
                left -= 1
    got = {r.g: r.quota for r in S.even_quotas(spark.createDataFrame(list(sizes.items()), "g string, n bigint"), "g", "n", total).collect()}
    assert got == quota
    rows = spark.createDataFrame([(f"{g}{i}", g) for g, n in sizes.items() for i in range(n)], "k string, g string")
    taken = S.balanced_sample(rows, "g", "k", total, salt="s").collect()
    want = {k for g, n in sizes.items() for k in sorted((f"{g}{i}" for i in range(n)), key=lambda k: (digest("s", k), k))[: quota[g]]}
    assert {r.k for r in taken} == want


def test_buckets_go_by_the_first_keyword_and_fill_in_order(spark):
    df = spark.createDataFrame([(1, "Semi Chips", "tech"), (2, "software", "TECH"), (3, None, "Technology"), (4, "bank", None), (5, "", "tech"), (6, "fish", "")], "i int, x string, y string")
    got = S.filled_buckets(df, S.keyword_bucket(["x", "y"], {"semi": ["chips"], "tech": ["tech"], "money": ["BANK"]}), "i", 2).collect()
    assert sorted((r.i, r.bucket, r.place) for r in got) == [(1, "semi", 1), (2, "tech", 1), (3, "tech", 2), (4, "money", 1)]


def test_nearest_ranks_take_no_row_twice(spark):
    rows = [(g, f"{g}{i}", i) for g, n in (("a", 30), ("b", 3), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, k string, v int").repartition(4)
    targets = [5, 5, 0, 6, 100]
    want = []
    for g, n in (("a", 30), ("b", 3), ("c", 1)):
        left = list(range(n))
        for t in targets:
            best = min(left, key=lambda x: (abs(x - t), x), default=None)
            want.append((g, t, best, None if best is None else f"{g}{best}"))
            if best is not None:
                left.remove(best)
    got = S.nearest_ranks(df, "g", [F.col("v")], "k", targets).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))

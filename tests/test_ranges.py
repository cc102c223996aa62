"""Range joins against all pairs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import ranges as G


def spans(seed, n, names):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a = rng.choice([rng.randrange(-40, 40), rng.randrange(-3000, 3000)])
        out.append((i, rng.choice(["x", "y", None]), a, a + rng.choice([0, 0, 1, 7, 90, 5000, -2])))
    return [*out, (n, "x", None, 5), (n + 1, "x", 5, None), (0, *out[0][1:])]


def test_overlapping_spans_equal_all_pairs(spark):
    a, b = spans(1, 80, "ab"), spans(2, 60, "cd")
    left = spark.createDataFrame(a, "i int, k string, s bigint, e bigint").repartition(3)
    right = spark.createDataFrame(b, "j int, g string, c bigint, d bigint").repartition(2)
    fine = lambda r: r[2] is not None and r[3] is not None and r[2] <= r[3]
    want = sorted((x[0], y[0]) for x in a for y in b if fine(x) and fine(y) and x[2] <= y[3] and y[2] <= x[3])
    got = G.overlapping(left, right, on=[], left_span=("s", "e"), right_span=("c", "d"))
    assert sorted((r.i, r.j) for r in got.collect()) == want and got.columns == ["i", "k", "s", "e", "j", "g", "c", "d"]
    keyed = G.overlapping(left, right, on=[("k", "g")], left_span=("s", "e"), right_span=("c", "d")).collect()
    assert sorted((r.i, r.j) for r in keyed) == sorted((x[0], y[0]) for x in a for y in b if fine(x) and fine(y) and x[1] is not None and x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])
    assert G.overlapping(left.limit(0), right, on=[], left_span=("s", "e"), right_span=("c", "d")).count() == 0


def test_dates_and_times_in_windows(spark):
    day = dt.date(2011, 12, 30)
    windows = spark.createDataFrame([(n, day + dt.timedelta(n), day + dt.timedelta(n + length)) for n, length in enumerate([0, 1, 5, 400, -1])], "w int, opens date, closes date")
    points = spark.createDataFrame([(n, day + dt.timedelta(n)) for n in range(-2, 420)] + [(999, None)], "p int, at date")
    got = sorted((r.p, r.w) for r in G.dates_in_windows(points, windows, on=[], at="at", span=("opens", "closes")).collect())
    assert got == sorted((p, w) for w, length in enumerate([0, 1, 5, 400]) for p in range(w, w + length + 1))
    stamps = lambda df, *names: df.withColumns({n: F.col(n).cast("timestamp") for n in names})
    timed = G.dates_in_windows(stamps(points, "at"), stamps(windows, "opens", "closes"), on=[], at="at", span=("opens", "closes"))
    assert sorted((r.p, r.w) for r in timed.collect()) == got
    with pytest.raises(TypeError):
        G.as_number(windows.withColumn("t", F.lit("x")), "t")


def test_blocks_are_few_and_make_up_the_span(spark):
    rows = spark.createDataFrame([(a, a + n) for a in (-7, 0, 5, 1023) for n in (0, 1, 2, 63, 64, 1000)], "a bigint, b bigint").withColumn("blocks", G._blocks(F.col("a"), F.col("b"))).collect()
    for r in rows:
        held = sorted(x for k, n in r.blocks for x in range(n << k, n + 1 << k))
        assert held == list(range(r.a, r.b + 1)) and len(r.blocks) <= 2 * (r.b - r.a + 1).bit_length()

import re
from collections import defaultdict

import numpy as np
import pytest
from lumenfold.llm import mixing as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def goals(sizes):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: M.WEIGHTS[k % 3] for k, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def check(rows, got):
    sizes, words = defaultdict(int), [(i, len(WORD.findall(t or "")), s) for i, t, s in rows]
    for _, n, s in words:
        sizes[s] += n
    assert sorted(((r[0], r[2], r[1]) for r in got), key=str) == sorted(words, key=str)
    wanted, taken, count, expected = goals(sizes), defaultdict(int), defaultdict(int), defaultdict(float)
    for _, source, size, source_size, target, copies in got:
        assert source_size == sizes[source] and target == pytest.approx(wanted[source])
        assert 0 <= copies <= 2
        taken[source] += copies * size
        count[source] += copies
        expected[source] += target / source_size if source_size else 0
    longest = max(n for _, n, _ in words)
    for s in sizes:
        assert abs(taken[s] - wanted[s]) <= 2 * longest
        assert abs(count[s] - expected[s]) <= 3


def test_hot_source_nulls_and_reruns(spark):
    rng = np.random.default_rng(9)
    rows = [(i, "w " * int(rng.integers(0, 90)), f"s{k}") for i, k in enumerate([0] * 6000 + [*range(1, 12)] * 40)]
    rows += [(None, "no id", "s1"), (7, None, None), (8, "null source here", None), (9, "", "s2"), (9, "", "s2"), (10, "Ä b", "Ä")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    cols = ["doc_id", "source", "size", "source_size", "target", "copies"]
    got = [tuple(r) for r in M.mix(docs).select(*cols).collect()]
    check(rows, got)
    again = [tuple(r) for r in M.mix(docs.repartition(3)).select(*cols).collect()]
    assert sorted(again, key=str) == sorted(got, key=str)
    assert M.mix(docs.limit(0)).count() == 0
    assert {r.copies for r in M.mix(docs.where("text is null")).collect()} == {0}


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 500):
        size, pi = rng.integers(0, 1000, n).astype(float), np.full(n, 0.3)
        out = M.flight(size, pi, b"seed")
        assert ((out > 0) & (out < 1)).sum() <= 2
        assert out.sum() == pytest.approx(pi.sum()) and (out * size).sum() == pytest.approx((pi * size).sum(), abs=1e-5)
        landed = M.land(size, out)
        assert set(landed) <= {0.0, 1.0}


def test_rows_are_taken(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    got = [tuple(r) for r in M.op6_source_mix(spark, sf).select("doc_id", "source", "size", "source_size", "target", "copies").collect()]
    check([(r.doc_id, r.text, r.source) for r in table.collect()], got)
    taken = M.take(table)
    assert taken.columns == table.columns
    counts = defaultdict(int, {r.doc_id: r["count"] for r in taken.groupBy("doc_id").count().collect()})
    assert all(counts[r[0]] == r[5] for r in got)
    twice = M.take(table.limit(40).unionByName(table.limit(40)))
    assert twice.count() > 0

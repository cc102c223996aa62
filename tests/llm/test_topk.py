import math

import numpy as np
from lumenfold.llm import topk as T
from pyspark.sql import functions as F


def brute_force(rows, k=10):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, seen = [], set()
    for i, q in sorted(good):
        if i % 100 or i in seen:
            continue
        seen.add(i)
        best = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), j) for j, x in good if j != i and len(x) == len(q))[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def test_ties_nulls_lengths_and_repeats(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 1, 40).tolist()) for i in range(700)]
    rows += [(i, rows[i % 50][1]) for i in range(700, 900)]  # ties
    rows += [(1000, None), (1001, [None] + [1.0] * 39), (1100, [float("nan")] * 40), (1101, [float("inf")] * 40), (None, [1.0] * 40)]
    rows += [(1200, [0.5, -0.5]), (1201, [1.0, 2.0]), (1300, []), (1301, []), (1400, [1.0] * 7), (200, rows[3][1]), (5, rows[5][1])]
    df = spark.createDataFrame([(i, v, 9) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = sorted(tuple(r) for r in T.top_k(df, F.col("vec_id") % 100 == 0).collect())
    assert got == brute_force(rows)
    assert T.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_tiles_prune_without_loss():
    rng = np.random.default_rng(8)
    m = np.floor(1024 * rng.normal(0, 1, (64, 3000))).astype(np.int64)
    m[:, 100:] //= 20  # most candidates fall to the bound
    queries = m[:, :5]
    best = T.Best(np.arange(5), queries, 10)
    best.seed(np.arange(50), m[:, :50])
    for lo in range(0, 3000, 500):
        best.scan(np.arange(lo, lo + 500), m[:, lo : lo + 500])
    full = queries.T @ m
    for q in range(5):
        wanted = sorted((-full[q, j], j) for j in range(3000) if j != q)[:10]
        assert list(zip(-best.score[q], best.id[q], strict=True)) == wanted
    assert best.computed < 0.5 * best.all


def test_share_that_survives_on_a_shared_table(spark):
    """Vectors of one norm in all directions are the worst case: most pairs go in the second half of the dimensions."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    ids, m = np.array([r.vec_id for r in rows]), np.floor(1024 * np.array([r.embedding for r in rows], np.float64).T).astype(np.int64)
    own = ids % 100 == 0
    best = T.Best(ids[own], m[:, own], 10)
    best.seed(ids, m)
    best.scan(ids, m)
    assert best.computed < 0.85 * best.all
    full = m[:, own].T @ m
    for q, i in enumerate(ids[own]):
        assert list(zip(-best.score[q], best.id[q], strict=True)) == sorted((-s, j) for s, j in zip(full[q], ids, strict=True) if j != i)[:10]


def test_scores_beyond_the_whole_numbers_of_doubles(spark):
    rows = [(0, [2.0**20, 2.0**-10]), *((j, [2.0**20, j * 2.0**-10]) for j in range(1, 15)), (50, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in T.top_k(df, F.col("vec_id") % 100 == 0).collect()) == brute_force(rows)


def test_whole_table_equals_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in T.op9_top_k(spark, sf).collect()) == brute_force(rows)

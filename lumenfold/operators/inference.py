"""Clustered inference and fixed-effect regression from sums that Spark makes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lumenfold.functions.values import student_t_quantile, student_t_sf
from lumenfold.sources.storage import materialize


def clustered_means(df: DataFrame, value: str, cluster: str, *, by: list[str], weight: str | None = None) -> DataFrame:
    """(by, mean, se, n, mass, clusters): weighted means with standard errors clustered in two aggregates:
    residual sums of each cluster, then their squares, by the factor g / (g - 1)."""
    w = F.col(weight) if weight else F.lit(1.0)
    rows = df.select(*by, F.col(cluster).alias("__c"), F.col(value).alias("__y"), w.alias("__w")).where("__y is not null and __w > 0")
    sums = rows.groupBy(*by, "__c").agg(F.sum(F.col("__w") * F.col("__y")).alias("__wy"), F.sum("__w").alias("__m"), F.count("*").alias("__n"))
    total = sums.groupBy(*by).agg((F.sum("__wy") / F.sum("__m")).alias("mean"))
    both = sums.join(F.broadcast(total), by) if by else sums.crossJoin(total)
    g, mass = F.count("*"), F.sum("__m")
    se = F.when(g > 1, F.sqrt(g / (g - 1) * F.sum(F.pow(F.col("__wy") - F.col("mean") * F.col("__m"), 2))) / mass)
    return both.groupBy(*by, "mean").agg(se.alias("se"), F.sum("__n").alias("n"), mass.alias("mass"), g.alias("clusters"))


def joint_covariance(df: DataFrame, value: str, cluster: str, portfolio: str, weight: str) -> DataFrame:
    """(a, b, covariance, shared): clustered covariance of portfolio means, a <= b. Influences of (cluster,
    portfolio) meet on the cluster; a cluster has no more rows than there are portfolios."""
    sums = df.where(F.col(value).isNotNull()).groupBy(F.col(portfolio).alias("p"), F.col(cluster).alias("c")).agg(F.sum(F.col(weight) * F.col(value)).alias("wy"), F.sum(weight).alias("m"))
    total = sums.groupBy("p").agg(F.sum("wy").alias("t"), F.sum("m").alias("mass"), F.count("*").alias("g"))
    inf = sums.join(F.broadcast(total), "p").select("p", "c", "g", ((F.col("wy") - F.col("t") / F.col("mass") * F.col("m")) / F.col("mass")).alias("i"))
    left, right = inf.select(F.col("p").alias("a"), "c", F.col("i").alias("ia")), inf.select(F.col("p").alias("b"), "c", F.col("i").alias("ib"))
    clusters = df.where(F.col(value).isNotNull()).agg(F.count_distinct(cluster).alias("all"))
    return left.join(right, "c").where("a <= b").groupBy("a", "b").agg(F.sum(F.col("ia") * F.col("ib")).alias("s"), F.count("*").alias("shared")).crossJoin(F.broadcast(clusters)).select("a", "b", (F.col("s") * F.col("all") / (F.col("all") - 1)).alias("covariance"), "shared")


def contrasts(means: DataFrame, covariance: DataFrame, portfolio: str) -> list[tuple]:
    """(a, b, difference, se, t, p) of all pairs of portfolios (25 at most), with the fewer clusters less one
    as degrees of freedom."""
    m = {r[portfolio]: r for r in means.collect()}
    c = {(r.a, r.b): r.covariance for r in covariance.collect()}
    out = []
    for a in sorted(m):
        for b in sorted(m):
            if a < b:
                diff, var = m[b]["mean"] - m[a]["mean"], c[a, a] + c[b, b] - 2 * c.get((a, b), 0.0)
                df = min(m[a]["clusters"], m[b]["clusters"]) - 1
                se = float(np.sqrt(max(var, 0.0)))
                t = diff / se if se else None
                out.append((a, b, float(diff), se, t, student_t_sf(abs(t), df) if t is not None and df > 0 else None))
    return out


def _centered(df: DataFrame, cols: list[str], group: str) -> DataFrame:
    """The columns less their group's means: a partial aggregate and a join; null is a group of its own."""
    means = df.groupBy(F.col(group).alias("__g")).agg(*[F.avg(c).alias(f"__{c}") for c in cols])
    out = df.join(means, F.col(group).eqNullSafe(F.col("__g")))
    return out.select(*[(F.col(c) - F.col(f"__{c}")).alias(c) if c in cols else F.col(c) for c in df.columns])


def _two_way(df: DataFrame, cols: list[str], large: str, small: str) -> DataFrame:
    """Both effects at once: the smaller group's are the solution of its normal equations after the larger
    group's are projected out (one row and column a group, summed in Spark); what is left loses the larger's."""
    cells = df.groupBy(F.col(large).alias("g"), F.col(small).alias("h")).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s{k}") for k, c in enumerate(cols)])
    total = cells.groupBy(F.col("g").alias("g2")).agg(F.sum("n").alias("all"), *[F.sum(f"s{k}").alias(f"t{k}") for k in range(len(cols))])
    cells = materialize(cells.join(total, F.col("g").eqNullSafe(F.col("g2"))).drop("g2"), "cells")
    sides = cells.groupBy("h").agg(F.sum("n").alias("n"), *[F.sum(F.col(f"s{k}") - F.col("n") * F.col(f"t{k}") / F.col("all")).alias(f"r{k}") for k in range(len(cols))]).collect()
    other = cells.select(F.col("g").alias("g2"), F.col("h").alias("h2"), F.col("n").alias("n2"))
    shared = cells.join(other, F.col("g").eqNullSafe(F.col("g2"))).groupBy("h", "h2").agg(F.sum(F.col("n") * F.col("n2") / F.col("all")).alias("w")).collect()
    place = {r.h: k for k, r in enumerate(sides)}
    matrix = np.diag([float(r.n) for r in sides])
    for r in shared:
        matrix[place[r.h], place[r.h2]] -= r.w
    effects = np.linalg.pinv(matrix, hermitian=True) @ np.array([[r[f"r{k}"] or 0.0 for k in range(len(cols))] for r in sides], float)
    schema = StructType([StructField("__h", df.schema[small].dataType), *[StructField(f"__{c}", DoubleType()) for c in cols]])
    table = df.sparkSession.createDataFrame([(r.h, *map(float, e)) for r, e in zip(sides, effects, strict=True)], schema)
    out = df.join(F.broadcast(table), F.col(small).eqNullSafe(F.col("__h")))  # the caller has counted the groups
    return _centered(out.select(*[(F.col(c) - F.col(f"__{c}")).alias(c) if c in cols else F.col(c) for c in df.columns]), cols, large)


def demeaned(df: DataFrame, cols: list[str], groups: list[str], *, tolerance: float = 1e-12, rounds: int = 10_000, direct: int = 1_000) -> DataFrame:
    """Projects out fixed effects; rows with a null in any of the columns are left out, a null group is a group.
    One group is one round of means. Two groups of which one has at most ``direct`` members are solved
    exactly. Else group means alternate until no value moves by the tolerance; an error if that takes more rounds."""
    out = df.dropna(subset=cols).withColumns({c: F.col(c).cast("double") for c in cols})
    if len(groups) == 1:
        return _centered(out, cols, groups[0])
    if len(groups) == 2:
        for small, large in (groups[::-1], groups):
            if out.select(small).distinct().limit(direct + 1).count() <= direct:
                return _two_way(out, cols, large, small)
    for _ in range(rounds):
        before = {c: F.col(c) for c in cols}
        new = out.withColumns({f"__old_{c}": v for c, v in before.items()})
        for g in groups:
            new = _centered(new, cols, g)
        new = materialize(new, "demeaned")
        moved = new.agg(F.max(F.greatest(*[F.abs(F.col(c) - F.col(f"__old_{c}")) for c in cols], F.lit(0.0)))).first()[0] or 0.0
        out = new.drop(*[f"__old_{c}" for c in cols])
        if moved < tolerance:
            return out
    raise ArithmeticError(f"fixed effects did not settle within {rounds} rounds")


def cross_products(df: DataFrame, y: str, xs: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """X'X, X'y and n: k x k sums in one aggregate."""
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"s{i}_{j}") for i, a in enumerate(xs) for j, b in enumerate([*xs, y])]
    r = df.agg(F.count("*").alias("n"), *sums).first()
    full = np.array([[r[f"s{i}_{j}"] for j in range(len(xs) + 1)] for i in range(len(xs))], float)
    return full[:, :-1], full[:, -1], r.n


def clustered_ols(df: DataFrame, y: str, xs: list[str], cluster: str, *, absorbed: int = 0) -> dict[str, dict[str, float]]:
    """Coefficients with CR1 clustered errors, t and p: scores of each cluster are summed in Spark, the k x k
    algebra is the driver's. ``absorbed`` counts projected effects."""
    xx, xy, n = cross_products(df, y, xs)
    inverse = np.linalg.pinv(xx)
    beta = inverse @ xy
    residual = F.col(y) - sum((F.col(x) * F.lit(float(b)) for x, b in zip(xs, beta, strict=True)), F.lit(0.0))
    scores = df.select(F.col(cluster).alias("__c"), *[(F.col(x) * residual).alias(f"e{k}") for k, x in enumerate(xs)]).groupBy("__c").agg(*[F.sum(f"e{k}").alias(f"e{k}") for k in range(len(xs))])
    meat = scores.agg(F.count("*").alias("g"), *[F.sum(F.col(f"e{i}") * F.col(f"e{j}")).alias(f"m{i}_{j}") for i in range(len(xs)) for j in range(len(xs))]).first()
    g, k = meat.g, len(xs) + absorbed
    factor = g / (g - 1) * (n - 1) / max(1, n - k)
    v = factor * inverse @ np.array([[meat[f"m{i}_{j}"] for j in range(len(xs))] for i in range(len(xs))]) @ inverse
    se = np.sqrt(np.diag(v))
    t975 = student_t_quantile(0.975, g - 1)
    return {x: {"beta": float(b), "se": float(s), "t": float(b / s) if s else float("nan"), "p": student_t_sf(abs(b / s), g - 1) if s else float("nan"), "low": float(b - t975 * s), "high": float(b + t975 * s)} for x, b, s in zip(xs, beta, se, strict=True)}


def influence(df: DataFrame, y: str, xs: list[str], cluster: str) -> tuple[DataFrame, DataFrame]:
    """Rows with residual, leverage and cooks (null where the leverage is 1), and for each cluster the first-order
    change of every coefficient that the cluster makes (d_<x>). Two aggregates; the k x k algebra is the driver's."""
    xx, xy, n = cross_products(df, y, xs)
    inverse = np.linalg.pinv(xx)
    beta, k = inverse @ xy, len(xs)
    weighted = lambda row: sum((F.col(x) * F.lit(float(v)) for x, v in zip(xs, row, strict=True)), F.lit(0.0))
    leverage = F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum((F.col(x) * weighted(inverse[i]) for i, x in enumerate(xs)), F.lit(0.0))))
    rows = df.withColumn("residual", F.col(y) - weighted(beta)).withColumn("leverage", leverage)
    mse = (rows.agg(F.sum(F.col("residual") * F.col("residual"))).first()[0] or 0.0) / max(1, n - k)
    cooks = F.when((F.col("leverage") < 1 - 1e-10) & F.lit(mse > 0), F.col("residual") ** 2 / F.lit(k * mse or 1.0) * F.col("leverage") / (1 - F.col("leverage")) ** 2)
    moves = rows.groupBy(cluster).agg(*[F.sum(weighted(inverse[i]) * F.col("residual")).alias(f"d_{x}") for i, x in enumerate(xs)])
    return rows.withColumn("cooks", cooks), moves


def inflation(df: DataFrame, xs: list[str]) -> dict[str, float]:
    """Variance inflation factors from the correlation matrix."""
    r = df.agg(*[F.corr(a, b).alias(f"c{i}_{j}") for i, a in enumerate(xs) for j, b in enumerate(xs)]).first()
    m = np.array([[r[f"c{i}_{j}"] if i != j else 1.0 for j in range(len(xs))] for i in range(len(xs))], float)
    return dict(zip(xs, np.diag(np.linalg.pinv(m)).tolist(), strict=True))

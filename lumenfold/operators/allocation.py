"""Winsorizing, quintiles and fractional membership of tied blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators.ranks import _meet, percentiles, positions, value_ranks
from lumenfold.sources.storage import materialize, small


def winsorized(df: DataFrame, cols: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Adds <col>_winsor: values cut to the linear percentiles of the whole column (one broadcast row)."""
    out = df
    for c in cols:
        out = out.join(F.broadcast(percentiles(df, c, [low, high], name=f"__{c}")), how="left")
        out = out.withColumn(f"{c}_winsor", F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.col(f"__{c}")[0]), F.col(f"__{c}")[1])))
    return out.drop(*[f"__{c}" for c in cols])


def equal_quintiles(df: DataFrame, value: str, key: str, name: str, *, by: list[str], bins: int = 5, salt: str = "ties") -> DataFrame:
    """Adds bins of nearly equal counts, floor(rank * bins / n) + 1; ties by a salted hash, then by key, which is unique."""
    tie = df.withColumn("__tie", F.sha2(F.concat_ws("|", F.lit(salt), F.col(key).cast("string")), 256))
    placed = positions(tie, by, [F.col(value).asc(), F.col("__tie").asc(), F.col(key).asc()], "__place")
    return placed.withColumn(name, (F.floor(F.col("__place") * bins / F.col("__place_of")) + 1).cast("int")).drop("__tie", "__place", "__place_of")


def competition_rank(df: DataFrame, value: str, name: str, *, by: list[str]) -> DataFrame:
    """Adds the descending rank (1, 1, 3) of finite values in the group and <name>_of, how many there are; other values
    have neither rank nor count (0)."""
    good = F.col(value).isNotNull() & ~F.isnan(value)
    ranks = materialize(value_ranks(df, value, by=by, descending=True), "ranks")
    sizes = materialize(ranks.groupBy(*by).agg(F.sum("n").alias(f"{name}_of")), "rank-sizes")
    out = _meet(df, ranks.select(*by, value, (F.col("before") + 1).alias(name)), [*by, value], "left")
    return _meet(out, small(sizes), by, "left").withColumn(f"{name}_of", F.when(good, F.col(f"{name}_of")).otherwise(0))


def fractional_membership(df: DataFrame, value: str, *, by: list[str], name: str, mass: str | None = None, bins: int = 5, weight: str = "weight") -> DataFrame:
    """One row for each bin that a row's tied block reaches, with its share of the row's mass.

    Values are first summed to blocks, so the running mass of a stratum runs over distinct values only; a
    block's mass interval meets the bins' equal intervals, and its rows share the overlap by their mass.
    """
    own = F.col(mass) if mass else F.lit(1.0)
    blocks = df.groupBy(*by, value).agg(F.sum(own).alias("__block"))
    w = Window.partitionBy(*by)
    blocks = blocks.withColumn("__end", F.sum("__block").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("__all", F.sum("__block").over(w))
    cut = blocks.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(bins))))
    overlap = F.least("__end", F.col(name) * F.col("__all") / bins) - F.greatest(F.col("__end") - F.col("__block"), (F.col(name) - 1) * F.col("__all") / bins)
    shares = cut.withColumn("__share", overlap / F.col("__block")).where(F.col("__share") > 1e-12).select(*by, value, name, "__share")
    return df.join(shares, [*by, value]).withColumn(weight, own * F.col("__share")).drop("__share")


def quantile_bins(df: DataFrame, value: str, name: str, bins: int = 5) -> DataFrame:
    """Adds the bin by quantile boundaries of the non-zero values (right-closed count of boundaries at or below);
    zeros are bin 0."""
    edges = percentiles(df.where(F.col(value) != 0), value, [k / bins for k in range(1, bins)], name="__edges")
    return df.join(F.broadcast(edges), how="left").withColumn(name, F.when(F.col(value) == 0, 0).otherwise(1 + F.size(F.filter("__edges", lambda e: e <= F.col(value))))).drop("__edges")

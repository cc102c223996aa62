"""Joins with contracts: what the keys promise, which rows met, and what became of columns of one name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.ranks import percentiles
from lumenfold.operators.records import ContractError

#: For each promise the sides whose keys are unique.
PROMISES = {"one_to_one": (True, True), "one_to_many": (True, False), "many_to_one": (False, True), "many_to_many": (False, False)}


def _unique(df: DataFrame, on: list[str], side: str) -> None:
    twice = df.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if twice:
        raise ContractError(f"keys {on} of the {side} side are repeated")


def contract_join(left: DataFrame, right: DataFrame, on: list[str], *, how: str = "left", promise: str = "many_to_one", status: str | None = None, complete: bool = False, suffix: str = "_right") -> DataFrame:
    """``left`` joined with ``right`` after the promise about their keys was checked by one aggregate a side.

    Columns of ``right`` whose name ``left`` has get the suffix. ``status`` names a column that says "matched" or
    "missing" of each row of ``left``; with ``complete`` a row of ``left`` that meets none is a ContractError. Null
    keys meet nothing, as in SQL.
    """
    for unique, df, side in zip(PROMISES[promise], (left, right), ("left", "right"), strict=True):
        if unique:
            _unique(df, on, side)
    if complete and (n := left.join(right.select(*on), on, "left_anti").count()):
        raise ContractError(f"{n} rows meet no row of the right side")
    renamed = {c: f"{c}{suffix}" for c in right.columns if c in left.columns and c not in on}
    out = left.join(right.withColumnsRenamed(renamed).withColumn("__met", F.lit(True)), on, how)
    if status:
        out = out.withColumn(status, F.when(F.col("__met"), "matched").otherwise("missing"))
    return out.drop("__met")


def unmatched(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``left`` whose key ``right`` does not have; null keys are among them."""
    return left.join(right.select(*on), on, "left_anti")


def head_and_tail(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first and the last k rows in the order, with ``end`` "head" or "tail" and their ``place``; each by a top-k of
    every task, without a sort of the whole. Fewer than 2k rows are in both."""
    from pyspark.sql import Window

    back = [F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])]
    placed = lambda name, by: df.withColumn("__o", back[0]).orderBy(by).limit(k).withColumn("place", F.row_number().over(Window.orderBy(by))).withColumn("end", F.lit(name)).drop("__o")
    return placed("head", F.col("__o").asc()).unionByName(placed("tail", F.col("__o").desc()))


def retention(before: DataFrame, after: DataFrame, key: str, score: str, n: int) -> DataFrame:
    """(n_before, kept, share): how many of the n highest of ``before`` are among the n highest of ``after``; ties
    by the key."""
    top = lambda df: df.orderBy(F.desc(score), key).limit(n).select(key)
    both = top(before).withColumn("__b", F.lit(1)).join(top(after).withColumn("__a", F.lit(1)), key, "left")
    return both.agg(F.count("*").alias("n_before"), F.count("__a").alias("kept")).withColumn("share", F.col("kept") / F.col("n_before"))


def quantile_bins(df: DataFrame, value: str, name: str, *, bins: int = 10) -> DataFrame:
    """Adds the bin of each value between the linear quantiles of the column, edges that are equal being one: bins
    are open below and closed above, but for the first, which holds its lower edge. Null values have no bin."""
    edges = percentiles(df, value, [k / bins for k in range(bins + 1)], name="__edges").select(F.array_distinct("__edges").alias("__edges"))
    below = F.size(F.filter("__edges", lambda e: e < F.col(value)))
    return df.join(F.broadcast(edges), how="left").withColumn(name, F.when(F.col(value).isNotNull(), F.greatest(below, F.lit(1)))).drop("__edges")

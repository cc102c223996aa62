"""Exact positions, ranks and percentiles of whole columns, however few the groups.

A window over a handful of strata sorts each in one task. Here rows are dealt by ranges of the order, so that a
partition holds a stretch of it; each partition sums its own rows, and a table of (partition, group) totals gives
every stretch the sum of those before it. Ranks run over distinct values with their counts, so no value is a hot key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.sources.storage import materialize, small

#: Equal-width bins of the first pass of percentiles.
BINS = 4096


def _meet(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join whose keys may be null; the columns of ``on`` come from the left."""
    renamed = right.withColumnsRenamed({c: f"__r_{c}" for c in on})
    if not on:
        return left.crossJoin(renamed)
    return left.join(renamed, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in on]), how).drop(*[f"__r_{c}" for c in on])


def running_before(rows: DataFrame, by: list[str], order: list[Column], weight: Column, name: str) -> DataFrame:
    """``rows`` with <name>: the sum of ``weight`` over the rows of the group that come before in the order, which has
    no ties. Null groups are groups of their own; an empty table gives no rows."""
    dealt = rows.withColumn("__w", weight).repartitionByRange(*[F.col(c).asc() for c in by], *order).withColumn("__part", F.spark_partition_id())
    dealt = materialize(dealt, "stretches")
    totals = dealt.groupBy(*by, "__part").agg(F.sum("__w").alias("__t"))
    past = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(totals.select(*by, "__part", F.coalesce(F.sum("__t").over(past), F.lit(0)).alias("__start")), "stretch-starts")
    own = Window.partitionBy("__part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumn("__own", F.coalesce(F.sum("__w").over(own), F.lit(0)))
    return _meet(inside, small(starts), [*by, "__part"]).withColumn(name, F.col("__start") + F.col("__own")).drop("__w", "__part", "__start", "__own")


def positions(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` with <name>, the place of each row in its group from 0, and <name>_of, the group's rows. The order must
    have no ties."""
    sizes = materialize(df.groupBy(*by).agg(F.count("*").alias(f"{name}_of")), "group-sizes")
    return _meet(running_before(df, by, order, F.lit(1), name), small(sizes), by)


def value_ranks(df: DataFrame, value: str, *, by: list[str], descending: bool = False) -> DataFrame:
    """(by, value, n, before): distinct values that are neither null nor NaN, their rows, and the rows before them."""
    good = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    counts = df.where(good).groupBy(*by, value).agg(F.count("*").alias("n"))
    return running_before(counts, by, [F.col(value).desc() if descending else F.col(value).asc()], F.col("n"), "before")


def spearman(df: DataFrame, x: str, y: str, *, by: list[str] | None = None, name: str = "spearman") -> DataFrame:
    """(by, n, name): the correlation of average ranks over rows with both values; null if either has one value only.

    Rows of equal values are summed first, and ranks are centred, so sums keep their digits.
    """
    by = by or []
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    pairs = materialize(df.where(good(x) & good(y)).groupBy(*by, F.col(x).alias("__x"), F.col(y).alias("__y")).agg(F.count("*").alias("__n")), "value-pairs")
    sizes = materialize(pairs.groupBy(*by).agg(F.sum("__n").alias("n")), "pair-sizes")
    out = _meet(pairs, small(sizes), by)
    for c in ("__x", "__y"):
        counts = pairs.groupBy(*by, c).agg(F.sum("__n").alias("__c"))
        ranks = running_before(counts, by, [F.col(c).asc()], F.col("__c"), "__before")
        out = _meet(out, ranks.select(*by, c, (F.col("__before") + (F.col("__c") + 1) / 2).alias(f"{c}r")), [*by, c])
    dx, dy, w = F.col("__xr") - (F.col("n") + 1) / 2, F.col("__yr") - (F.col("n") + 1) / 2, F.col("__n")
    sums = out.groupBy(*by, "n").agg(F.sum(w * dx * dy).alias("__xy"), F.sum(w * dx * dx).alias("__xx"), F.sum(w * dy * dy).alias("__yy"))
    return sums.select(*by, "n", F.when((F.col("__xx") > 0) & (F.col("__yy") > 0), F.col("__xy") / F.sqrt(F.col("__xx") * F.col("__yy"))).alias(name))


def percentiles(df: DataFrame, value: str, shares: list[float], *, by: list[str] | None = None, name: str = "percentiles") -> DataFrame:
    """(by, name array<double>): linear percentiles of each group's values that are neither null nor NaN.

    One pass counts equal-width bins between the least and the greatest value; only the bins that hold a wanted
    place are ranked. Groups without a value have no row.
    """
    by = by or []
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(*by, v.alias("__v"))
    ends = materialize(rows.groupBy(*by).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.count("*").alias("__n")).where("__n > 0"), "ends")
    share = (F.col("__v") / 2 - F.col("__lo") / 2) / (F.col("__hi") / 2 - F.col("__lo") / 2)
    binned = _meet(rows, small(ends), by).withColumn("__bin", F.when(F.col("__hi") > F.col("__lo"), F.least(F.floor(share * BINS), F.lit(BINS - 1))).otherwise(F.lit(0)))
    counts = binned.groupBy(*by, "__bin", "__n").agg(F.count("*").alias("__c"))
    past = Window.partitionBy(*by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__below", F.coalesce(F.sum("__c").over(past), F.lit(0)))
    place = lambda s, up: (F.ceil if up else F.floor)(F.lit(s) * (F.col("__n") - 1)).cast("bigint")
    places = F.array_distinct(F.array(*[place(s, up) for s in shares for up in (False, True)]))
    wanted = counts.withColumn("__places", F.filter(places, lambda p: (p >= F.col("__below")) & (p < F.col("__below") + F.col("__c")))).where(F.size("__places") > 0)
    wanted = materialize(wanted.select(*by, "__bin", "__below", "__places"), "wanted-bins")
    inside = _meet(binned.select(*by, "__bin", "__v"), small(wanted.select(*by, "__bin")), [*by, "__bin"], "left_semi") if by else binned.select("__bin", "__v").join(small(wanted.select("__bin")), "__bin", "left_semi")
    ranked = running_before(inside.groupBy(*by, "__bin", "__v").agg(F.count("*").alias("__c")), [*by, "__bin"], [F.col("__v").asc()], F.col("__c"), "__before")
    hit = _meet(ranked, small(wanted), [*by, "__bin"]).withColumn("__first", F.col("__below") + F.col("__before"))
    hit = hit.withColumn("__p", F.explode(F.filter("__places", lambda p: (p >= F.col("__first")) & (p < F.col("__first") + F.col("__c")))))
    found = hit.groupBy(*by).agg(F.map_from_entries(F.collect_set(F.struct("__p", "__v"))).alias("__at"))  # two places a share at most
    at = lambda s, up: F.element_at(F.col("__at"), place(s, up))
    part = lambda s: F.lit(s) * (F.col("__n") - 1) - place(s, False)
    return _meet(found, small(ends), by).select(*by, F.array(*[at(s, False) + (at(s, True) - at(s, False)) * part(s) for s in shares]).alias(name))

"""Reproducible samples: order by salted hashes, quotas by largest remainders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators.ranks import _meet, positions
from lumenfold.sources.storage import materialize, small

#: Parts of a group by hash, each cut to its first rows before they meet.
SALTS = 64


def draw_order(salt: str, *key: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(salt), *[F.col(k).cast("string") for k in key]), 256)


def first_per_stratum(df: DataFrame, strata: list[str], key: str, n: int, *, salt: str) -> DataFrame:
    """The first n of each stratum in hash order, with their place."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*strata).orderBy(draw_order(salt, key), key))).where(F.col("place") <= n)


def quotas(df: DataFrame, stratum: str, total: int) -> DataFrame:
    """(stratum, size, quota): total dealt in proportion, the remainder to the largest fractions (ties by name).
    Strata are few: their table is one aggregate."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("size"))
    w = Window.partitionBy()
    exact = F.col("size") * total / F.sum("size").over(w)
    out = sizes.withColumn("__x", exact).withColumn("__base", F.floor("__x"))
    out = out.withColumn("__left", total - F.sum("__base").over(w)).withColumn("__rank", F.row_number().over(w.orderBy(F.desc(F.round(F.col("__x") - F.col("__base"), 9)), stratum)))
    return out.select(stratum, "size", (F.col("__base") + (F.col("__rank") <= F.col("__left")).cast("int")).cast("bigint").alias("quota"))


def stratified_sample(df: DataFrame, stratum: str, key: str, total: int, *, salt: str) -> DataFrame:
    """A sample of the quotas in hash order, with the design weight size / quota."""
    placed = positions(df.withColumn("__draw", draw_order(salt, key)), [stratum], [F.col("__draw").asc(), F.col(key).asc()], "__place")
    taken = placed.join(small(materialize(quotas(df, stratum, total), "quotas")), stratum).where(F.col("__place") < F.col("quota"))
    return taken.withColumn("place", (F.col("__place") + 1).cast("int")).withColumn("design_weight", F.col("size") / F.col("quota")).drop("size", "quota", "__draw", "__place", "__place_of")


def bernoulli(df: DataFrame, key: str, per_million: int, *, salt: str) -> DataFrame:
    """Rows whose salted hash falls under the threshold: a sample that reruns and other engines draw alike."""
    part = F.conv(F.substring(draw_order(salt, key), 1, 8), 16, 10).cast("bigint")
    return df.where(part % 1_000_000 < per_million)


def interleaved(df: DataFrame, group: str, order: str) -> DataFrame:
    """Adds turn, for an order that takes one row of each group before a second of any."""
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(order)))


def reservoir(df: DataFrame, by: list[str], key: str, k: int, *, salt: str) -> DataFrame:
    """k rows of each group, those of the least salted hashes, with ``place`` from 1 and ``seen``, the group's rows.

    The least k of two parts are the least k of the least k of each, so every group is cut in SALTS parts by its
    hashes first and no task holds a whole group; the sample is the same however the rows are dealt. The key is unique.
    """
    drawn = df.withColumn("__draw", draw_order(salt, key)).withColumn("__salt", F.pmod(F.xxhash64("__draw"), F.lit(SALTS)))
    order = [F.col("__draw").asc(), F.col(key).asc()]
    near = drawn.withColumn("place", F.row_number().over(Window.partitionBy(*by, "__salt").orderBy(*order))).where(F.col("place") <= k)
    least = near.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k).drop("__draw", "__salt")
    return _meet(least, df.groupBy(*by).agg(F.count("*").alias("seen")), by)


def even_quotas(supply: DataFrame, group: str, size: str, total: int) -> DataFrame:
    """(group, size, quota): the total dealt evenly, what small groups can't fill dealt evenly to the others and so on.

    The fixed point is a level: groups up to it give all they have, the others floor(level), and the remainder goes to
    the first of these by name. Quotas sum to the total, or to all there is. Groups are few: a row each.
    """
    rising = Window.partitionBy().orderBy(size, group)
    every = Window.partitionBy()
    own = supply.withColumn("__before", F.coalesce(F.sum(size).over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("__left", F.count("*").over(every) - F.row_number().over(rising) + 1)
    level = (F.lit(total) - F.col("__before")) / F.col("__left")
    own = own.withColumn("__level", F.min(F.when(F.col(size) > level, F.struct((-F.col("__left")).alias("at"), level.alias("level")))).over(every)["level"])
    over = F.col("__level").isNotNull() & (F.col(size) > F.col("__level"))
    own = own.withColumn("__base", F.when(over, F.floor("__level")).otherwise(F.col(size))).withColumn("__over", over)
    spare = F.least(F.lit(total), F.sum(size).over(every)) - F.sum("__base").over(every)
    own = own.withColumn("__spare", spare).withColumn("__turn", F.row_number().over(Window.partitionBy("__over").orderBy(group)))
    return own.select(group, size, (F.col("__base") + (F.col("__over") & (F.col("__turn") <= F.col("__spare"))).cast("bigint")).cast("bigint").alias("quota"))


def balanced_sample(df: DataFrame, group: str, key: str, total: int, *, salt: str) -> DataFrame:
    """``total`` rows, as evenly over the groups as their sizes allow, in hash order within each; adds place and quota."""
    quota = materialize(even_quotas(df.groupBy(group).agg(F.count("*").alias("__size")), group, "__size", total), "even-quotas")
    placed = positions(df.withColumn("__draw", draw_order(salt, key)), [group], [F.col("__draw").asc(), F.col(key).asc()], "__place")
    taken = _meet(placed, small(quota), [group]).where(F.col("__place") < F.col("quota"))
    return taken.withColumn("place", (F.col("__place") + 1).cast("bigint")).drop("__draw", "__place", "__place_of", "__size")


def keyword_bucket(texts: list[str], buckets: dict[str, list[str]]) -> Column:
    """The first bucket of which a keyword stands in any of the columns, in any case; else null."""
    lower = [F.lower(F.coalesce(F.col(t), F.lit(""))) for t in texts]
    out = F.lit(None).cast("string")
    for name, words in reversed(buckets.items()):
        hit = F.lit(False)
        for w in words:
            for text in lower:
                hit = hit | text.contains(w.lower())
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def filled_buckets(df: DataFrame, bucket: Column, order: str, quota: int) -> DataFrame:
    """The first ``quota`` rows of each bucket in the order, which has no ties; adds bucket and place. Rows of no bucket
    are left out."""
    own = df.withColumn("bucket", bucket).where("bucket is not null").withColumn("__salt", F.pmod(F.xxhash64(order), F.lit(SALTS)))
    near = own.withColumn("place", F.row_number().over(Window.partitionBy("bucket", "__salt").orderBy(order))).where(F.col("place") <= quota)
    return near.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy(order))).where(F.col("place") <= quota).drop("__salt")


def nearest_ranks(df: DataFrame, group: str, order: list[Column], key: str, targets: list[int]) -> DataFrame:
    """(group, target, rank, key): for each target rank (from 0) in turn the row of the nearest rank that no target before
    took, ties to the smaller rank; null if a group has no rows left. The order has no ties.

    Only ranks less than len(targets) from a target (or from the last rank) can be taken, so a group comes
    together as that many rows a target.
    """
    n = len(targets)
    placed = positions(df.select(group, F.col(key).alias("__key"), *[c.alias(f"__o{i}") for i, c in enumerate(order)]), [group], [F.col(f"__o{i}") for i in range(len(order))], "rank")
    near = F.lit(False)
    for t in targets:
        near = near | (F.abs(F.col("rank") - F.least(F.lit(t), F.col("rank_of") - 1)) < n)
    rows = placed.where(near).groupBy(group).agg(F.sort_array(F.collect_list(F.struct("rank", F.col("__key").alias("key")))).alias("rows"))

    def take(state: Column, t: Column) -> Column:
        gap = F.transform(state["left"], lambda x: F.struct(F.abs(x["rank"] - t).alias("gap"), x["rank"].alias("rank"), x["key"].alias("key")))
        best = F.array_min(gap)
        left = F.filter(state["left"], lambda x: best.isNull() | (x["rank"] != best["rank"]))
        return F.struct(left.alias("left"), F.concat(state["taken"], F.array(F.struct(t.alias("target"), best["rank"].alias("rank"), best["key"].alias("key")))).alias("taken"))

    none = F.array().cast(f"array<struct<target:int,rank:bigint,key:{rows.schema['rows'].dataType.elementType['key'].dataType.simpleString()}>>")
    taken = F.aggregate(F.array(*[F.lit(t) for t in targets]), F.struct(F.col("rows").alias("left"), none.alias("taken")), take, lambda s: s["taken"])
    return rows.select(group, F.explode(taken).alias("x")).select(group, "x.target", "x.rank", F.col("x.key").alias(key))

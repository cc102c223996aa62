"""Joins in time: as-of, intervals, nearest dates, trading calendars and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(probes: DataFrame, history: DataFrame, *, key: str, at: str, since: str, value: str, id_col: str) -> DataFrame:
    """Adds <value>, its date and a status: the value of the latest history row at or before the probe; two
    different values on that date are a conflict without a value, no row is missing.

    Both sides are sorted into one timeline of each key and the last date is carried forward: linear in the
    rows, where an inequality join would pair every probe with all its past.
    """
    past = history.where(F.col(since).isNotNull()).groupBy(F.col(key).alias("__k"), F.col(since).alias("__t")).agg(F.count_distinct(value).alias("__n"), F.min(value).alias("__v"))
    line = past.select("__k", "__t", F.struct("__t", "__n", "__v").alias("__h"), F.lit(0).alias("__o"), F.lit(None).cast(probes.schema[id_col].dataType).alias("__id"))
    line = line.unionByName(probes.select(F.col(key).alias("__k"), F.col(at).alias("__t"), F.lit(None).cast(line.schema["__h"].dataType).alias("__h"), F.lit(1).alias("__o"), F.col(id_col).alias("__id")))
    w = Window.partitionBy("__k").orderBy("__t", "__o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = line.withColumn("__h", F.last("__h", ignorenulls=True).over(w)).where("__o = 1")
    status = F.when(F.col("__h").isNull(), "missing").when(F.col("__h.__n") > 1, "conflict").otherwise("matched")
    return got.select(F.col("__id").alias(id_col), F.col("__k").alias(key), F.col("__t").alias(at), F.when(status == "matched", F.col("__h.__v")).alias(value), F.col("__h.__t").alias(f"{since}_used"), status.alias("status"))


def calendar(dates: DataFrame, date: str) -> DataFrame:
    """(date, t): trading days numbered from 0; a calendar is some thousands of days."""
    days = dates.select(F.col(date).alias("date")).where("date is not null").distinct()
    return days.withColumn("t", (F.row_number().over(Window.orderBy("date")) - 1).cast("int"))


def asof_forward(events: DataFrame, days: DataFrame, *, at: str) -> DataFrame:
    """Adds t, the first trading day on or after the event; null beyond the calendar. Every civil day of the
    calendar's span gets its trading day, so the join is by equality."""
    span = days.agg(F.min("date").alias("a"), F.max("date").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("civil"))
    w = Window.orderBy("civil").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    table = span.join(days, F.col("civil") == F.col("date"), "left").withColumn("next", F.first("t", ignorenulls=True).over(w)).select("civil", F.col("next").alias("t"))
    first = F.broadcast(days.agg(F.min("date").alias("__first")))
    return events.crossJoin(first).withColumn("civil", F.greatest(F.col(at), F.col("__first"))).join(F.broadcast(table), "civil", "left").drop("civil", "__first")


def daily_returns(prices: DataFrame, days: DataFrame, *, key: str, date: str, price: str) -> DataFrame:
    """(key, t, ret): returns over consecutive calendar days; null if either price is missing or not above 0."""
    own = prices.join(F.broadcast(days.withColumnRenamed("date", "__date")), F.col(date) == F.col("__date")).select(key, "t", F.when(F.col(price) > 0, F.col(price)).alias("p"))
    w = Window.partitionBy(key).orderBy("t")
    before = F.when(F.lag("t").over(w) == F.col("t") - 1, F.lag("p").over(w))
    return own.select(key, "t", (F.col("p") / before - 1).alias("ret"))


def nearest_after(left: DataFrame, right: DataFrame, *, key: str, at: str, date: str, least: int, most: int, id_col: str) -> DataFrame:
    """For each left row the earliest right date of its key that is least to most days later; one row each."""
    pairs = left.join(right.select(key, F.col(date).alias("__d")).distinct(), key, "left").withColumn("__lag", F.datediff("__d", at))
    hit = F.when(F.col("__lag").between(least, most), F.col("__d"))
    return pairs.groupBy(id_col, key, at).agg(F.min(hit).alias("nearest"))


def carried_flag(df: DataFrame, flag: str, name: str, *, by: str, order: str) -> DataFrame:
    """Adds whether the flag was ever set up to the row."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.max(F.col(flag)).over(w))

"""Range joins by dyadic intervals: dates in windows, spans that contain a date, spans that overlap.

A span is cut into at most two blocks of 2^k units of each size, and a point lies in one block of each size. Span and
point meet in exactly one block, by an equality join of (keys, size, block), so every pair that the join
makes is a result: the work is linear in the rows (times the number of sizes) and in the matches. Overlapping spans
meet by the later of their starts, which lies in both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.sources.storage import materialize


def as_number(df: DataFrame, name: str) -> Column:
    """Dates as days, timestamps as microseconds, whole numbers as they are; null beyond 2^62."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(name).cast("bigint")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(name).cast("timestamp"))
    if isinstance(kind, T.IntegralType):
        return F.when(F.abs(F.col(name).cast("bigint")) < 1 << 62, F.col(name).cast("bigint"))
    raise TypeError(f"{name} is neither a date, a timestamp nor a whole number")


def _blocks(first: Column, last: Column) -> Column:
    """The blocks (k, n), n * 2^k to (n + 1) * 2^k - 1, that make up a closed span; none of an empty one."""
    end = last + 1

    def of(k: Column) -> Column:
        # floor and ceiling of a division by 2^k
        low, high = -F.call_function("shiftright", -first, k), F.call_function("shiftright", end, k)
        odd = lambda x: F.pmod(x, F.lit(2)) == 1
        both = F.array(F.when((low < high) & odd(low), low), F.when((low < high) & odd(high), high - 1))
        return F.transform(F.array_compact(both), lambda n: F.struct(k.cast("int").alias("k"), n.alias("n")))

    # a block of 2^k is used only if the span holds one, so larger sizes than its length have none
    sizes = F.sequence(F.lit(0), F.greatest(F.floor(F.log2((end - first).cast("double"))).cast("int"), F.lit(0)) + 1)
    return F.when(first <= last, F.flatten(F.transform(sizes, of))).otherwise(F.array().cast("array<struct<k:int,n:bigint>>"))


def _pack(df: DataFrame, name: str) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def _meet(points: DataFrame, spans: DataFrame, keys: int) -> DataFrame:
    """points (k0.., at, p) and spans (k0.., first, last, s) -> (p, s) of each point in a span of equal keys."""
    on = [f"k{i}" for i in range(keys)]
    cut = materialize(spans.where("first <= last").select(*on, "s", F.explode(_blocks(F.col("first"), F.col("last"))).alias("b")).select(*on, "s", "b.k", "b.n"), "blocks")
    used = sorted(r.k for r in cut.select("k").distinct().collect())  # 63 sizes at most
    up = F.array(*[F.struct(F.lit(k).alias("k"), F.shiftright("at", k).alias("n")) for k in used]) if used else F.array().cast("array<struct<k:int,n:bigint>>")
    lifted = points.where("at is not null").select(*on, "p", F.explode(up).alias("b")).select(*on, "p", "b.k", "b.n")
    return lifted.join(cut, [*on, "k", "n"]).select("p", "s")


def _unpacked(pairs: DataFrame, left: str, right: str) -> DataFrame:
    return pairs.select(f"{left}.*", f"{right}.*")


def dates_in_windows(points: DataFrame, windows: DataFrame, *, on: list[tuple[str, str]], at: str, span: tuple[str, str]) -> DataFrame:
    """All columns of both sides for each point within a closed window of equal keys; on: (points' key, windows' key).

    Names of the two sides differ. Null keys, points and ends meet nothing, and a window that ends before it
    starts is empty. Repeated rows meet each.
    """
    own = points.select(*[F.col(a).alias(f"k{i}") for i, (a, _) in enumerate(on)], as_number(points, at).alias("at"), _pack(points, "p"))
    spans = windows.select(*[F.col(b).alias(f"k{i}") for i, (_, b) in enumerate(on)], as_number(windows, span[0]).alias("first"), as_number(windows, span[1]).alias("last"), _pack(windows, "s"))
    return _unpacked(_meet(own, spans, len(on)), "p", "s")


def overlapping(left: DataFrame, right: DataFrame, *, on: list[tuple[str, str]], left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """All columns of both sides for each pair of equal keys whose closed spans share a unit; names differ.

    Either the right span starts in the left one, or the left one starts in the rest of the right one.
    Nulls, empty spans and repeats as in dates_in_windows().
    """
    a = left.select(*[F.col(x).alias(f"k{i}") for i, (x, _) in enumerate(on)], as_number(left, left_span[0]).alias("first"), as_number(left, left_span[1]).alias("last"), _pack(left, "l")).where("first <= last")
    b = right.select(*[F.col(y).alias(f"k{i}") for i, (_, y) in enumerate(on)], as_number(right, right_span[0]).alias("first"), as_number(right, right_span[1]).alias("last"), _pack(right, "r")).where("first <= last")
    as_point = lambda df, name: df.withColumnRenamed("first", "at").withColumnRenamed(name, "p").drop("last")
    one = _meet(as_point(b, "r"), a.withColumnRenamed("l", "s"), len(on)).select(F.col("s").alias("l"), F.col("p").alias("r"))
    two = _meet(as_point(a, "l"), b.withColumn("first", F.col("first") + 1).withColumnRenamed("r", "s"), len(on)).select(F.col("p").alias("l"), F.col("s").alias("r"))
    return _unpacked(one.unionByName(two), "l", "r")

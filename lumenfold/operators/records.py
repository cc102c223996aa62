"""Record quality: duplicates, canonical rows, reconciliation, gates, roll-ups and contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.sources.storage import materialize


class ContractError(ValueError):
    """A table breaks what was promised of it."""


def checked(df: DataFrame, *, columns: list[str] | None = None, keys: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """``df``, if it has the columns, unique non-null keys and the number of rows; else ContractError. One pass."""
    missing = sorted(set(columns or []) - set(df.columns))
    if missing:
        raise ContractError(f"missing columns: {missing}")
    if keys:
        r = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows"), F.count_if(F.col("n") > 1).alias("twice"), F.count_if(F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0)) > 0).alias("none")).first()
        if r.twice or r.none:
            raise ContractError(f"keys {keys}: {r.twice} repeated, {r.none} null")
        found = r.rows or 0
    else:
        found = df.count() if rows is not None else None
    if rows is not None and found != rows:
        raise ContractError(f"{found} rows, {rows} were promised")
    return df


def invariants(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(name, passed, broken): named row conditions in one pass; a null condition is broken."""
    r = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    return r.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("broken")) for n in checks])).alias("x")).select("x.name", (F.col("x.broken") == 0).alias("passed"), "x.broken")


def table_diff(left: DataFrame, right: DataFrame, key: str, cols: list[str], *, atol: float = 0.0, rtol: float = 0.0) -> DataFrame:
    """(column, only_left, only_right, different): cells beyond atol + rtol * |right|, and keys of one side."""
    a, b = left.select(key, F.lit(1).alias("__l"), *cols), right.select(key, F.lit(1).alias("__r"), *[F.col(c).alias(f"__{c}") for c in cols])
    both = a.join(b, key, "full_outer")
    met = F.col("__l").isNotNull() & F.col("__r").isNotNull()
    far = lambda c: met & ~F.col(c).eqNullSafe(F.col(f"__{c}")) & F.coalesce(F.abs(F.col(c) - F.col(f"__{c}")) > atol + rtol * F.abs(F.col(f"__{c}")), F.lit(True))
    sums = both.agg(F.count_if(F.col("__r").isNull()).alias("l"), F.count_if(F.col("__l").isNull()).alias("r"), *[F.count_if(far(c)).alias(c) for c in cols])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col("l").alias("only_left"), F.col("r").alias("only_right"), F.col(c).alias("different")) for c in cols])).alias("x")).select("x.*")


def duplicate_groups(df: DataFrame, content: Column, *, order: list) -> DataFrame:
    """Adds content_hash, copies, canonical (the first of the order) and is_duplicate; rows without content are
    no duplicates of each other."""
    first = order[0]
    out = df.withColumn("content_hash", F.when(F.length(F.trim(content)) > 0, F.sha2(content, 256)))
    groups = out.where("content_hash is not null").groupBy("content_hash").agg(F.count("*").alias("copies"), F.min(F.struct(*order)).alias("__head"))
    out = out.join(groups, "content_hash", "left").withColumn("copies", F.coalesce("copies", F.lit(1))).withColumn("canonical", F.coalesce(F.col("__head")[first], F.col(first)))
    return out.withColumn("is_duplicate", F.col("canonical") != F.col(first)).drop("__head")


def best_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def sequential_dedup(df: DataFrame, first_key: str, second_key: str, order: str) -> DataFrame:
    """Adds status: in order, a row whose first key a kept row had before is dup_first, else one whose second key
    was had is dup_second, else it is kept. Only kept rows register their keys, so fates hang on earlier ones.

    Each round keeps all rows that come first among the undecided of both their keys and drops the others with
    those keys; rounds are as many as the longest chain of such dependences. ``order`` is unique.
    """
    open_ = materialize(df.select(order, first_key, second_key), "open")
    kept = None
    while open_.limit(1).count():
        a = open_.groupBy(first_key).agg(F.min(order).alias("__a"))
        b = open_.groupBy(second_key).agg(F.min(order).alias("__b"))
        now = open_.join(a, first_key).join(b, second_key).where((F.col(order) == F.col("__a")) & (F.col(order) == F.col("__b")))
        now = materialize(now.select(order, first_key, second_key), "kept")
        kept = now if kept is None else kept.unionByName(now)
        open_ = materialize(open_.join(now.select(first_key).distinct(), first_key, "left_anti").join(now.select(second_key).distinct(), second_key, "left_anti").select(order, first_key, second_key), "open")
    if kept is None:
        return df.withColumn("status", F.lit("kept"))
    first = kept.groupBy(F.col(first_key).alias("__k")).agg(F.min(order).alias("__first"))
    own = kept.select(F.col(order).alias("__own"), F.lit(True).alias("__kept"))
    status = F.when(F.col("__kept"), "kept").when(F.col("__first") < F.col(order), "dup_first").otherwise("dup_second")
    return df.join(own, F.col(order) == F.col("__own"), "left").join(first, F.col(first_key) == F.col("__k"), "left").withColumn("status", status).drop("__own", "__kept", "__k", "__first")


def history(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, attempts, history, last): values joined by ';' in order."""
    rows = F.sort_array(F.collect_list(F.struct(order, value)))
    return df.groupBy(*keys).agg(F.count("*").alias("attempts"), F.array_join(F.transform(rows, lambda x: x[value].cast("string")), ";").alias("history"), F.max_by(value, order).alias("last"))


def agreed_value(df: DataFrame, key: str, value: str, rank: Column) -> DataFrame:
    """(key, value, sources, conflict): the value of the best-ranked source, and whether others differ."""
    return df.where(F.col(value).isNotNull()).groupBy(key).agg(F.min_by(value, F.struct(rank.alias("r"), F.col(value))).alias(value), F.count("*").alias("sources"), (F.count_distinct(value) > 1).alias("conflict"))


def reconciled(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(state, n): keys on both sides, missing, or unexpected."""
    a, b = expected.select(*keys).distinct().withColumn("__e", F.lit(1)), found.select(*keys).distinct().withColumn("__f", F.lit(1))
    state = F.when(F.col("__f").isNull(), "missing").when(F.col("__e").isNull(), "unexpected").otherwise("matched")
    return a.join(b, keys, "full_outer").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def gate_funnel(df: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """(step, gate, retained, excluded): gates one after another, counted in one aggregate."""
    cum, sums, so_far = [], [F.count("*").alias("g0")], F.lit(True)
    for k, (name, gate) in enumerate(gates.items(), 1):
        so_far = so_far & F.coalesce(gate, F.lit(False))
        sums.append(F.count_if(so_far).alias(f"g{k}"))
        cum.append((k, name))
    rows = [F.struct(F.lit(k).alias("step"), F.lit(n).alias("gate"), F.col(f"g{k}").alias("retained"), (F.col(f"g{k - 1}") - F.col(f"g{k}")).alias("excluded")) for k, n in [(0, "all"), *cum] if k] + []
    return df.agg(*sums).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def exclusion_reasons(gates: dict[str, Column]) -> Column:
    """The names of gates that a row fails, once each, in order, joined by ';'."""
    return F.array_join(F.array_distinct(F.array_compact(F.array(*[F.when(~F.coalesce(g, F.lit(False)), n) for n, g in gates.items()]))), ";")


def rollups(df: DataFrame, dims: list[str], aggs: list[Column]) -> DataFrame:
    """(dimension, value, aggregates): a roll-up over each dimension apart, by grouping sets in one aggregate."""
    which = F.coalesce(*[F.when(F.grouping(d) == 0, F.lit(d)) for d in dims])
    value = F.coalesce(*[F.when(F.grouping(d) == 0, F.coalesce(F.col(d).cast("string"), F.lit(""))) for d in dims])
    return df.groupingSets([[F.col(d)] for d in dims], *dims).agg(*aggs, which.alias("dimension"), value.alias("value")).drop(*dims)


def bijective(df: DataFrame, a: str, b: str) -> DataFrame:
    """(direction, many): how many keys of either side have several partners."""
    ab = df.groupBy(a).agg(F.count_distinct(b).alias("n")).agg(F.count_if(F.col("n") > 1).alias("many")).withColumn("direction", F.lit(f"{a}->{b}"))
    ba = df.groupBy(b).agg(F.count_distinct(a).alias("n")).agg(F.count_if(F.col("n") > 1).alias("many")).withColumn("direction", F.lit(f"{b}->{a}"))
    return ab.unionByName(ba).select("direction", "many")

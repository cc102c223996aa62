"""Mixing sources to target weights by the cube method.

A source's target over its size gives every document of it a number of whole copies and one inclusion
probability. Probabilities move along the null space of the balancing constraints (number of documents and
words) until one of three reaches 0 or 1, and the next document takes its place. Blocks of a source fly
apart; the two documents that a block leaves open fly on with those of other blocks, until one block is
left, whose open documents land where the words' total is nearest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import empty_if_null, materialize, small
from .quality import SPACE

WEIGHTS = [3, 1, 2]
#: Share of all sizes that the targets share, and the most copies' worth of a source.
SHARE, MOST = 1.5, 2.0
#: Documents of one flight.
BLOCK = 2000
TINY = 1e-9


def sized(docs: DataFrame, *, id_col: str, text_col: str, source_col: str) -> DataFrame:
    words = F.size(F.array_remove(F.split(empty_if_null(text_col), SPACE), "")).cast("bigint")
    return materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words.alias("size")), "sizes")


def targets(sizes: DataFrame, *, weights: list[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, n, source_size, target): the sources in the order of code points, null last, take the weights in
    turn. The level that all unstopped sources share rises as sources stop at ``most`` times their size; each
    round is one aggregate over the sources, of which only sums come to the driver."""
    sums = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    ordered = sums.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    placed = materialize(ordered.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1).cast("bigint")).alias("own")), "sources")
    before, offsets = 0, []
    for r in placed.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # a row a partition
        offsets.append((r.part, before))
        before += r.n
    spark = sizes.sparkSession
    ranked = placed.join(F.broadcast(spark.createDataFrame(offsets, "part int, offset bigint")), "part")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("own") + F.col("offset"), F.lit(len(weights))) + 1).cast("int"))
    ranked = materialize(ranked.select("source", "n", "source_size", weight.alias("weight"), (most * F.col("source_size")).alias("cap")), "weights")
    total = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:
        over = F.lit(level) * F.col("weight") > F.col("cap")
        r = ranked.agg(F.sum(F.when(over, F.col("cap")).otherwise(0.0)).alias("fixed"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("open"), F.sum(over.cast("int")).alias("stopped")).first()
        if r.stopped is None or r.stopped == stopped or not r.open:
            break
        level, stopped = (total - r.fixed) / r.open, r.stopped
    return ranked.select("source", "n", "source_size", F.least(F.lit(level) * F.col("weight"), F.col("cap")).alias("target"))


def flight(size: np.ndarray, pi: np.ndarray, seed: bytes) -> np.ndarray:
    """Moves probabilities, keeping their sum and that of pi * size, until at most two are open."""
    rng = np.random.default_rng(int.from_bytes(hashlib.sha256(seed).digest()[:8], "big"))
    p, s, draws = pi.tolist(), size.tolist(), iter(rng.random(2 * len(pi) + 4).tolist())
    trio: list[int] = []
    waiting = iter(range(len(p)))
    while True:
        while len(trio) < 3:
            nxt = next(waiting, None)
            if nxt is None:
                break
            if TINY < p[nxt] < 1 - TINY:
                trio.append(nxt)
        if len(trio) < 2:
            break
        a = [s[i] for i in trio]
        if len(trio) == 3:
            u = [a[2] - a[1], a[0] - a[2], a[1] - a[0]] if not a[0] == a[1] == a[2] else [1, -1, 0]
        elif a[0] == a[1]:
            u = [1, -1]
        else:
            break
        up = min((1 - p[i]) / d if d > 0 else p[i] / -d for i, d in zip(trio, u, strict=True) if d)
        down = min(p[i] / d if d > 0 else (1 - p[i]) / -d for i, d in zip(trio, u, strict=True) if d)
        step = up if next(draws) * (up + down) < down else -down
        for i, d in zip(trio, u, strict=True):
            p[i] += step * d
        trio = [i for i in trio if TINY < p[i] < 1 - TINY]
    out = np.array(p)
    out[out <= TINY], out[out >= 1 - TINY] = 0.0, 1.0
    return out


def land(size: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """Rounds the open probabilities (two at most) to the total of words nearest to theirs."""
    out, open_ = pi.copy(), np.flatnonzero((pi > 0) & (pi < 1))
    wanted = float((pi[open_] * size[open_]).sum())
    tries = [[k >> j & 1 for j in range(len(open_))] for k in range(1 << len(open_))]
    best = min(tries, key=lambda t: (abs(float((np.array(t) * size[open_]).sum()) - wanted), abs(sum(t) - pi[open_].sum()), t)) if len(open_) else []
    out[open_] = best
    return out


def flyer(last: bool, salt: str):
    """The flight of a block as a function of Arrow tables; the last one lands."""

    def fly(table: pa.Table) -> pa.Table:
        ids, size = table.column("id").to_pylist(), table.column("size").to_numpy()
        order = sorted(range(len(ids)), key=lambda i: (str(ids[i]), int(size[i])))
        table = table.take(pa.array(order))
        size, pi = size[order].astype(np.float64), table.column("pi").to_numpy()
        pi = flight(size, pi, f"{salt}|{table.column('source')[0].as_py()}|{table.column('block')[0].as_py()}".encode())
        return table.set_column(table.column_names.index("pi"), "pi", pa.array(land(size, pi) if last else pi))

    return fly


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: list[float] = WEIGHTS) -> DataFrame:
    """(id, source, size, source_size, target, copies) of every row: how often the mix takes it.

    A null text has size 0; the null source is a source, the last. Repeated rows are documents of their own.
    Blocks and draws depend on ids, sizes and sources only, so reruns agree (rows equal in all three are
    interchangeable). Without any word all targets are 0. An empty table gives no rows.
    """
    sizes = sized(docs, id_col=id_col, text_col=text_col, source_col=source_col)
    spark = sizes.sparkSession
    goals = materialize(targets(sizes, weights=weights), "targets")
    rows = sizes.join(small(goals).withColumnRenamed("source", "goal"), F.col("source").eqNullSafe(F.col("goal"))).drop("goal")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.select("id", "source", "size", "source_size", "target", F.floor(ratio).cast("bigint").alias("whole"), (ratio - F.floor(ratio)).alias("pi"), F.col("n").alias("open"))
    rows = materialize(rows, "open")
    is_open = (F.col("pi") > TINY) & (F.col("pi") < 1 - TINY)
    done, level = [rows.where(~is_open).select("id", "source", "size", "source_size", "target", (F.col("whole") + F.round("pi")).cast("bigint").alias("copies"))], 0
    flying = rows.where(is_open)
    schema = flying.withColumn("block", F.lit(0).cast("bigint")).schema
    while True:
        level += 1
        most = flying.agg(F.max("open")).first()[0]
        if most is None:
            break
        last = most <= BLOCK
        salt = f"flight {level}"
        dealt = flying.withColumn("block", F.pmod(F.xxhash64("id", "size", F.lit(salt)), F.ceil(F.col("open") / BLOCK)))

        flown = materialize(dealt.groupBy("source", "block").applyInArrow(flyer(last, salt), schema), "flown")
        done.append(flown.where(~is_open).select("id", "source", "size", "source_size", "target", (F.col("whole") + F.round("pi")).cast("bigint").alias("copies")))
        if last:
            break
        # what blocks left open, two each at most, flies on
        rest = materialize(flown.where(is_open).drop("block", "open"), "rest")
        counts = materialize(rest.groupBy(F.col("source").alias("goal")).agg(F.count("*").alias("open")), "counts")
        flying = rest.join(small(counts), F.col("source").eqNullSafe(F.col("goal"))).select(*flying.columns)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.withColumnRenamed("id", id_col).withColumnRenamed("source", source_col)


def take(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` as the mix takes them: a row for each copy, none for documents left out."""
    plan = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col)
    words = F.size(F.array_remove(F.split(empty_if_null(text_col), SPACE), "")).cast("bigint")
    plan = materialize(plan.groupBy(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), F.col("size").alias("__n")).agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows")), "plan")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(id_col).alias("__own"), F.col(source_col).cast("string").alias("__of"), words.alias("__words"))
    joined = packed.join(plan.hint("merge"), F.col("__own").eqNullSafe(F.col("__id")) & F.col("__of").eqNullSafe(F.col("__source")) & (F.col("__words") == F.col("__n")))
    # rows equal in id, source and size share their copies evenly; the first few take one more
    share = F.floor(F.col("__copies") / F.col("__rows"))
    single = joined.where("__rows = 1").select("__row", F.col("__copies").alias("__k"))
    if plan.where("__rows > 1").limit(1).count():
        from pyspark.sql import Window

        place = F.row_number().over(Window.partitionBy("__id", "__source", "__n").orderBy(F.xxhash64(F.col("__row").getField(text_col))))
        many = joined.where("__rows > 1").withColumn("__place", place).select("__row", (share + (F.col("__place") <= F.col("__copies") - share * F.col("__rows")).cast("bigint")).alias("__k"))
        single = single.unionByName(many)
    return single.where("__k > 0").select("__row", F.explode(F.sequence(F.lit(1), F.col("__k").cast("int")))).select("__row.*")


def op6_source_mix(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    got = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")

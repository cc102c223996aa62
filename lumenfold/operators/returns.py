"""Event studies: a four-factor regression before each event, and abnormal returns after it.

An estimation window must be whole, so the regressors of all events of one trading day are the same: the design of a
day is solved once for the calendar, and what a key adds are sliding sums over its own series of returns. No event
makes rows of its own; events read a (key, day) table by an equality join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.sources.storage import materialize, small

FACTORS = ["mkt_rf", "smb", "hml", "mom"]
FIRST, LAST, ROWS = -209, -10, 200
AFTER = {"car_0_1": (0, 1), "car_2_60": (2, 60)}
COEFFICIENTS = ["alpha", "b_mkt", "b_smb", "b_hml", "b_mom"]
_N = len(COEFFICIENTS)
_SOLVED = T.StructType([T.StructField("rank", T.IntegerType()), T.StructField("condition", T.DoubleType()), T.StructField("inverse", T.ArrayType(T.DoubleType()))])


@F.pandas_udf(_SOLVED)
def _solved(windows: pd.Series) -> pd.DataFrame:
    """Rank, condition number and (X'X)^-1 of each whole window of regressors; null if days are missing."""
    out = []
    for cells in windows:
        if cells is None or len(cells) != ROWS * _N:
            out.append((None, None, None))
            continue
        _, sizes, v = np.linalg.svd(np.asarray(cells, float).reshape(ROWS, _N), full_matrices=False)
        rank = int((sizes > sizes[0] * ROWS * np.finfo(float).eps).sum())
        inverse = ((v.T / sizes**2) @ v).ravel().tolist() if rank == _N else None
        out.append((rank, float(sizes[0] / sizes[-1]) if sizes[-1] else None, inverse))
    frame = pd.DataFrame(out, columns=["rank", "condition", "inverse"])
    return frame.astype({"rank": "Int32", "condition": "float64"})


def _finite(c: str) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c).cast("double"))


def designs(days: DataFrame, factors: DataFrame) -> DataFrame:
    """(t, date, x, rf, estimation dates, missing factor days, rank, condition, inverse, sums of x after): one row
    a trading day of the calendar, which is some thousands of rows; ``x`` is null where a factor or rf is."""
    f = factors.select(F.col("t").alias("__t"), *[_finite(c).alias(c) for c in [*FACTORS, "rf"]])
    none = F.exists(F.array(*FACTORS, "rf"), lambda c: c.isNull())
    cal = days.select("t", "date").join(f, F.col("t") == F.col("__t"), "left")
    cal = cal.select("t", "date", F.when(~none, F.array(F.lit(1.0), *FACTORS)).alias("x"), "rf")
    line = Window.orderBy("t")
    before, cols = line.rangeBetween(FIRST, LAST), [F.lag("date", -FIRST).over(line).alias("estimation_start"), F.lag("date", -LAST).over(line).alias("estimation_end")]
    cols += [(F.count("*").over(before) - F.count("x").over(before)).alias("n_missing_factors"), F.flatten(F.collect_list("x").over(before)).alias("__cells")]
    cols += [F.array(*[F.sum(F.col("x")[j]).over(line.rangeBetween(a, b)) for j in range(_N)]).alias(f"__x_{name}") for name, (a, b) in AFTER.items()]
    wide = cal.select("t", "date", "x", "rf", *cols).withColumn("__s", _solved("__cells"))
    return wide.select("t", "date", "x", "rf", "estimation_start", "estimation_end", "n_missing_factors", "__s.rank", "__s.condition", "__s.inverse", *[f"__x_{n}" for n in AFTER])


def _series(placed: DataFrame, returns: DataFrame, cal: DataFrame, key: str) -> DataFrame:
    """(key, t, sums over the windows around t): a row for each calendar day that a window of the key's events
    holds. A key's series has at most the calendar's days, whatever its events or rows."""
    span = placed.where(F.col("t") >= 1 - FIRST).groupBy(F.col(key).alias("__key")).agg(F.min("t").alias("a"), F.max("t").alias("b"))
    last = max(b for _, b in AFTER.values())
    grid = span.select("__key", F.explode(F.sequence(F.col("a") + FIRST, F.col("b") + last)).alias("t")).join(small(cal.select("t", "date", "x", "rf")), "t")
    own = returns.select(F.col(key).alias("__k"), F.col("t").alias("__t"), _finite("ret").alias("ret"))
    grid = grid.join(own, F.col("__key").eqNullSafe(F.col("__k")) & (F.col("t") == F.col("__t")), "left")
    grid = grid.select("__key", "t", "date", "ret", "x", F.when(F.col("x").isNotNull(), F.col("ret") - F.col("rf")).alias("y"))
    line = Window.partitionBy("__key").orderBy("t")
    before, bad = line.rangeBetween(FIRST, LAST), F.when(F.col("y").isNull(), F.col("date"))
    cols = [F.count("y").over(before).alias("n_obs"), F.count_if(F.col("ret").isNull()).over(before).alias("n_missing_prices"), F.collect_list(bad).over(before).alias("missing"), F.sum(F.col("y") * F.col("y")).over(before).alias("__yy")]
    cols.append(F.array(*[F.sum(F.col("y") * F.col("x")[j]).over(before) for j in range(_N)]).alias("__xy"))
    for name, (a, b) in AFTER.items():
        w = line.rangeBetween(a, b)
        cols += [F.count("y").over(w).alias(f"__n_{name}"), F.sum("y").over(w).alias(f"__y_{name}"), F.collect_list(bad).over(w).alias(f"__bad_{name}")]
    return grid.select("__key", F.col("t").alias("__t"), *cols)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def event_study(events: DataFrame, returns: DataFrame, factors: DataFrame, days: DataFrame, *, key: str, at: str) -> DataFrame:
    """One row for each event, its columns kept (but those named like a result): status, fit, and a status, count, missing days and sum for each
    window of abnormal returns (days 0 to 1, and 2 to 60).

    ``events`` hold key, the date ``at`` and ``t``, their trading day (null beyond the calendar); returns are (key, t,
    ret), factors (t, four factors, rf), days (t, date) numbered from 0. Statuses: unconfirmed_call_date (null date),
    insufficient_factor_calendar (t null or under 210), missing_estimation_prices_or_factors, rank_deficient, ok. A
    missing estimation day never shortens the window; a missing later day only voids the sums that hold it. Null
    keys and keys without returns have missing prices; equal events are repeated rows with equal results. Values that are
    not finite are missing. Sums of squares of residuals come from moments, so those under 1e-15 of the total are noise.
    """
    cal = materialize(designs(days, factors), "designs")
    sums = _series(events, returns, cal, key)
    facts = cal.select(F.col("t").alias("__d"), F.col("date").alias("event_trading_date"), *cal.columns[4:])
    top = cal.agg(F.max("t").alias("__top"))
    packed = events.select(F.struct(*[F.col(f"`{c}`") for c in events.columns]).alias("__e"), F.col(key).alias("__own"), F.col("t").cast("int").alias("t"), F.col(at).alias("__at"))
    out = packed.join(sums, F.col("__own").eqNullSafe(F.col("__key")) & (F.col("t") == F.col("__t")), "left").join(small(facts), F.col("t") == F.col("__d"), "left").crossJoin(F.broadcast(top))
    status = (
        F.when(F.col("__at").isNull(), "unconfirmed_call_date")
        .when(F.col("t").isNull() | (F.col("t") < 1 - FIRST), "insufficient_factor_calendar")
        .when(F.coalesce("n_obs", F.lit(0)) < ROWS, "missing_estimation_prices_or_factors")
        .when(F.col("rank") < _N, "rank_deficient").otherwise("ok")
    )
    out = out.withColumn("status", status)
    ok, tried = F.col("status") == "ok", ~F.col("status").isin("unconfirmed_call_date", "insufficient_factor_calendar")
    out = out.withColumn("__b", F.when(ok, F.array(*[_dot(F.slice("inverse", j * _N + 1, _N), F.col("__xy")) for j in range(_N)])))
    sse, sst = F.greatest(F.col("__yy") - _dot(F.col("__b"), F.col("__xy")), F.lit(0.0)), F.col("__yy") - F.col("__xy")[0] * F.col("__xy")[0] / ROWS
    cols = [F.when(tried, F.coalesce(c, F.lit(0))).alias(c) for c in ("n_obs", "n_missing_prices", "n_missing_factors")]
    cols += [F.when(tried, F.col(c)).alias(c) for c in ("event_trading_date", "estimation_start", "estimation_end")]
    cols += [F.when(tried, F.datediff("event_trading_date", "__at")).alias("day_0_lag"), F.when(tried & ~ok, F.array_join(F.col("missing").cast("array<string>"), ";")).alias("missing_estimation_dates")]
    cols += [F.when(F.col("status").isin("ok", "rank_deficient"), F.col(c)).alias(n) for c, n in (("rank", "matrix_rank"), ("condition", "condition"))]
    cols += [F.col("__b")[j].alias(c) for j, c in enumerate(COEFFICIENTS)]
    cols += [F.when(ok, F.sqrt(sse / (ROWS - _N))).alias("rmse"), F.when(ok & (sst > 0), 1 - sse / sst).alias("r2")]
    for name, (a, b) in AFTER.items():
        outside = F.filter(F.sequence(F.lit(a), F.lit(b)), lambda k: F.col("t") + k > F.col("__top"))  # noqa: B023
        missing = F.concat(F.col(f"__bad_{name}").cast("array<string>"), F.transform(outside, lambda k: F.concat(F.lit("day_"), k.cast("string"), F.lit("_outside_factor_calendar"))))
        whole = ok & (F.col(f"__n_{name}") == b - a + 1)
        cols += [
            F.when(~ok, "model_unavailable").when(whole, "ok").otherwise("missing_event_prices_or_factors").alias(f"{name}_status"),
            F.when(ok, F.col(f"__n_{name}")).alias(f"{name}_observations"),
            F.when(ok, F.array_join(missing, ";")).alias(f"{name}_missing_dates"),
            F.when(whole, F.col(f"__y_{name}") - _dot(F.col("__b"), F.col(f"__x_{name}"))).alias(name),
        ]
    found = out.select("__e", "status", *cols)
    return found.select(*[F.col("__e")[c].alias(c) for c in events.columns if c not in found.columns], *found.columns[1:])

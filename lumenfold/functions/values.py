"""Dates, identifiers and numbers as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_date(text: Column) -> Column:
    """ISO or YYYYMMDD; null for anything else."""
    return F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_date(text, "yyyyMMdd"))


def quarter_label(d: Column) -> Column:
    return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))


def quarter_start(label: Column) -> Column:
    return F.make_date(F.substring(label, 1, 4).cast("int"), F.substring(label, 6, 1).cast("int") * 3 - 2, F.lit(1))


def quarter_end(label: Column) -> Column:
    return F.last_day(F.add_months(quarter_start(label), 2))


def in_period(label: Column, first: str, last: str) -> Column:
    """Whether a well-formed quarter label lies in the period."""
    return label.rlike(r"^\d{4}Q[1-4]$") & label.between(first, last)


def fiscal_period_end(year: Column, quarter: Column, end_month: Column) -> Column:
    """The end of a fiscal quarter: so many quarters before the fiscal year's end month."""
    return F.last_day(F.add_months(F.make_date(year, end_month, F.lit(1)), 3 * (quarter - 4)))


def surrogate_id(prefix: str, *parts: Column, width: int = 16) -> Column:
    return F.concat(F.lit(prefix), F.upper(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, width)))


def padded(code: Column, width: int) -> Column:
    return F.lpad(F.trim(code), width, "0")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf)


def factor_value(percent: Column, sentinel: float = 90.0) -> Column:
    """A percentage as a fraction; values of the sentinel's size are missing."""
    return F.when(F.abs(percent) < sentinel, percent / 100)


#: Fixed values. (first, last, division): two-digit industry groups; 18, 68 and 90 have none.
DIVISIONS = [(1, 9, "agriculture"), (10, 14, "mining"), (15, 17, "construction"), (20, 39, "manufacturing"), (40, 49, "transport_utilities"), (50, 51, "wholesale"), (52, 59, "retail"), (60, 67, "finance"), (70, 89, "services"), (91, 99, "public_administration")]


def sic_division(sic: Column) -> Column:
    group = F.floor(sic.cast("int") / 100)
    out = F.lit(None).cast("string")
    for first, last, name in DIVISIONS:
        out = F.when(group.between(first, last), name).otherwise(out)
    return out


def student_t_sf(t: float, df: float) -> float:
    """Two-sided tail probability of Student's t, by the continued fraction of the incomplete beta function."""
    x = df / (df + t * t)
    return _incomplete_beta(df / 2, 0.5, x)


def student_t_quantile(p: float, df: float) -> float:
    """The t of a cumulative probability over one half, by bisection."""
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        if 1 - student_t_sf(mid, df) / 2 < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def _incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h / a

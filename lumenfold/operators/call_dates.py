"""Dates that a text gives for a call, by the words around them, and vocabularies with all regular forms of their terms."""

from __future__ import annotations

import bisect
import datetime
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.text import inflections

#: What announces a call; words that lead to a date behind it, and from a date to the call.
CUES = r"conference call|earnings call|investor call|results call|webcast"
LEADS = r"\b(?:on|for|scheduled|beginning|starts?|commencing)\b"
BRIDGES = r"\b(?:will|plans? to|scheduled to|host|hold)\b"
#: Characters before a cue and behind it that belong to it; how near a date needs no lead, how far a lead reaches;
#: characters of an excerpt to either side of a date, and in all.
BEFORE, BEHIND, NEAR, LEAD, AROUND, EXCERPT = 180, 420, 90, 55, 180, 700
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
_NUMBER = {m[:3].lower(): k + 1 for k, m in enumerate(MONTHS)}
# A month in full, by three letters or as Sept, perhaps with a full stop; a day, perhaps an ordinal; a year from 2000 on
_DATE = re.compile(rf"\b({'|'.join(f'{m[:3]}(?:{m[3:]})?' if m != 'September' else 'Sep(?:t(?:ember)?)?' for m in MONTHS)})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(20\d{{2}})\b", re.I)
_CUE, _LEAD, _BRIDGE = re.compile(CUES, re.I), re.compile(LEADS, re.I), re.compile(BRIDGES, re.I)


def _announced(text: str | None) -> list[dict]:
    """Every date and cue is found once; a cue then looks at the dates in its own stretch only."""
    dates = []
    for m in _DATE.finditer(text or ""):
        try:
            dates.append((m.start(), m.end(), datetime.date(int(m[3]), _NUMBER[m[1][:3].lower()], int(m[2]))))
        except ValueError:  # no such day
            continue
    starts, out = [d[0] for d in dates], {}
    for cue in _CUE.finditer(text or "") if dates else ():
        low, high = max(0, cue.start() - BEFORE), cue.end() + BEHIND
        for at in range(bisect.bisect_left(starts, low), len(dates)):
            start, end, day = dates[at]
            if end > high:
                break
            if start >= cue.start():
                said = start - cue.start() <= NEAR or _LEAD.search(text, max(cue.start(), start - LEAD), start)
            else:
                between = text[end : cue.start()]
                said = "." not in between and _BRIDGE.search(between)
            if said:
                excerpt = " ".join(text[max(low, start - AROUND) : min(high, end + AROUND)].split())[:EXCERPT]
                out.setdefault((day, excerpt))
    return [{"day": day, "excerpt": excerpt} for day, excerpt in out]


def announced_dates(text: Column) -> Column:
    """Dates that stand for a call, with what is around them: near a cue (conference call, webcast, ...) behind it or led to by on, for,
    scheduled, ...; or before it in one sentence that says will, host, hold, ... Each pair once, by cues and then dates.

    Only years from 2000 on, days that exist, and dates that lie whole within 180 characters before a cue or 420 behind it. Null
    and empty texts have none.
    """

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(_announced)

    return F.pandas_udf(run, "array<struct<day: date, excerpt: string>>")(text)


def call_dates(docs: DataFrame, text: str, *, id_col: str) -> DataFrame:
    """(id, place, day, excerpt): one row for each date that a text announces a call for, in order from 0."""
    found = docs.select(F.col(id_col), announced_dates(F.col(text)).alias("__d"))
    return found.select(id_col, F.posexplode("__d").alias("place", "x")).select(id_col, "place", "x.*")


def with_inflections(terms: DataFrame, *, term: str = "term", weight: str = "weight") -> DataFrame:
    """(term, weight, source): a weighted vocabulary and the regular singular and plural of every term's last word, each with the
    largest weight of the terms that it comes from (source, the least of them). Null and blank terms and null or NaN weights
    are left out; terms are trimmed, with single spaces."""
    clean: Column = F.trim(F.regexp_replace(term, r"\s+", " "))
    rows = terms.select(clean.alias("source"), F.col(weight).cast("double").alias("weight")).where("source <> '' and weight is not null and not isnan(weight)")
    forms = rows.groupBy("source").agg(F.max("weight").alias("weight")).select("source", "weight", F.explode(inflections(F.col("source"))).alias("term"))
    best = forms.groupBy("term").agg(F.max("weight").alias("weight"), F.min(F.struct((-F.col("weight")).alias("a"), "source")).alias("s"))
    return best.select("term", "weight", F.col("s.source").alias("source"))

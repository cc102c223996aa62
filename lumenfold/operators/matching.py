"""Entity resolution: cascades of unique matches, fuzzy names, exclusions, dates in text and reused names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators.ranges import overlapping

#: Words in names of securities that are no operating company's common stock, first match counts.
EXCLUDED_NAMES = {
    "warrant": r"\b(warrant|warrants|wt|wts)\b",
    "right": r"\b(right|rights|rt|rts)\b",
    "unit": r"\b(unit|units)\b",
    "preferred": r"\b(preferred|preference|depositary shares?)\b",
    "fund": r"\b(etf|fund|shares index)\b",
    "acquisition_vehicle": r"\b(acquisition corp|blank check)\b",
    "when_issued": r"\bwhen issued\b",
}
EXCLUDED_SYMBOLS = r"[-.](P[A-Z]?|W|WS|U|R)$"
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def unique_matches(table: DataFrame, key: Column, value: str) -> DataFrame:
    """(k, v): keys that name one value only."""
    return table.where(key.isNotNull() & (key != "")).groupBy(key.alias("k")).agg(F.min(value).alias("v"), F.count_distinct(value).alias("n")).where("n = 1").select("k", "v")


def cascade(rows: DataFrame, steps: list[tuple[str, Column, DataFrame]]) -> DataFrame:
    """Adds match and match_rule: the first step (rule, key of the row, unique (k, v) table) that answers; each
    is one join by equality."""
    out, values, rules = rows, [], []
    for n, (rule, key, table) in enumerate(steps):
        out = out.withColumn(f"__k{n}", key).join(table.select(F.col("k").alias(f"__t{n}"), F.col("v").alias(f"__v{n}")), F.col(f"__k{n}") == F.col(f"__t{n}"), "left")
        values.append(F.col(f"__v{n}"))
        rules.append(F.when(F.col(f"__v{n}").isNotNull(), rule))
    out = out.withColumn("match", F.coalesce(*values)).withColumn("match_rule", F.coalesce(*rules, F.lit("unmatched")))
    return out.drop(*[f"__{c}{n}" for n in range(len(steps)) for c in "ktv"])


def most_shared_words(left: DataFrame, right: DataFrame, *, left_id: str, right_id: str, words: str, least_length: int = 4) -> DataFrame:
    """(left_id, best, shared): the right row that shares most long words, if it is strictly best. Candidates
    come from an inverted index on the words, never from all pairs; a word of a tenth of the right side or
    more names nothing and is left out of the index, which is part of the definition."""
    index = right.select(F.col(right_id).alias("r"), F.explode(F.array_distinct(words)).alias("w")).where(F.length("w") >= least_length)
    common = index.groupBy("w").agg(F.count("*").alias("n")).crossJoin(F.broadcast(right.agg(F.count("*").alias("all")))).where("n * 10 < all").select("w")
    probes = left.select(F.col(left_id).alias("l"), F.explode(F.array_distinct(words)).alias("w")).join(common, "w")
    counts = probes.join(index, "w").groupBy("l", "r").agg(F.count("*").alias("shared"))
    w = Window.partitionBy("l").orderBy(F.desc("shared"), "r")
    top = counts.withColumn("place", F.row_number().over(w)).withColumn("next", F.lead("shared").over(w)).where("place = 1")
    return top.where("next is null or next < shared").select(F.col("l").alias(left_id), F.col("r").alias("best"), "shared")


def exclusion(name: Column, symbol: Column) -> Column:
    """The first reason why a security is left out, or null."""
    lower, out = F.lower(name), F.when(symbol.rlike(EXCLUDED_SYMBOLS), "symbol")
    for reason, pattern in EXCLUDED_NAMES.items():
        out = out.when(lower.rlike(pattern), reason)
    return out


def text_dates(text: Column) -> Column:
    """Dates in free text, in order of the three grammars: month day, year; day month year; ISO."""
    names = "|".join(MONTHS)
    lower = F.lower(F.coalesce(text, F.lit("")))
    number = lambda m: F.array_position(F.array(*[F.lit(x) for x in MONTHS]), m).cast("int")

    def grammar(pattern: str, year: int, month: int, day: int) -> Column:
        whole = F.regexp_extract_all(lower, F.lit(pattern), F.lit(0))
        part = lambda x, k: F.regexp_extract(x, pattern, k)
        named = month != 2 or "(" + names in pattern
        return F.transform(whole, lambda x: F.try_to_date(F.concat_ws("-", part(x, year), F.lpad(number(part(x, month)).cast("string") if named else part(x, month), 2, "0"), F.lpad(part(x, day), 2, "0")), "yyyy-MM-dd"))

    found = F.concat(grammar(rf"\b({names})\s+(\d{{1,2}}),?\s+(\d{{4}})\b", 3, 1, 2), grammar(rf"\b(\d{{1,2}})\s+({names})\s+(\d{{4}})\b", 3, 2, 1), grammar(r"\b(\d{4})-(\d{2})-(\d{2})\b", 1, 2, 3))
    return F.array_distinct(F.array_compact(found))


def quarter_mention(text: Column, year: Column, quarter: Column) -> Column:
    """Whether the text names the fiscal quarter: the quarter by number or ordinal and the year, in either order
    and at most 80 characters of a sentence apart (``third quarter of fiscal 2012``, ``fiscal year 2012, Q3 quarter``),
    or the short form ``Q3 2012``."""
    ordinal = F.element_at(F.array(*[F.lit(x) for x in ("first|1st", "second|2nd", "third|3rd", "fourth|4th")]), quarter)
    name = F.concat(F.lit(r"(?:q\s*"), quarter.cast("string"), F.lit("|"), ordinal, F.lit(r")\s+(?:fiscal\s+)?quarter"))
    y, gap = year.cast("string"), F.lit("[^.]{0,80}")
    short = F.concat(F.lit(r"\bq\s*"), quarter.cast("string"), F.lit(r"\s+(?:of\s+|fiscal\s+)*"), y, F.lit(r"\b"))
    after = F.concat(name, F.lit(r"(?:[^.]{0,80}\b|\s+(?:of\s+)?(?:fiscal\s+)?)"), y)
    before = F.concat(F.lit(r"(?:\b|fiscal\s+(?:year\s+)?)"), y, gap, name)
    return F.regexp_like(F.coalesce(text, F.lit("")), F.concat(F.lit("(?i)(?:"), short, F.lit("|"), after, F.lit("|"), before, F.lit(")")))


#: Cues of a live call, words of a replay, of other meetings and of a schedule.
REPLAY = r"\b(replay|archiv\w*|until|through|expires?|expiration)\b"
OTHER_MEETINGS = r"investor (day|meeting|conference)|analyst day|summit|agenda|no later than|dividend|record date"
SCHEDULE = r"\b(will|hold|host|begin\w*|scheduled|on|conduct)\b"
CALLS = r"conference call|earnings call|results call"
SPOKEN = r"\b(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?\s+(\d{1,2})(?:st|nd|rd|th)?(?:,?\s+(\d{4}))?"


def live_call(day: Column, text: Column) -> Column:
    """How the text bears on a live call on the day: 'live' or 'live_year_implied' (the date follows a call that is
    scheduled), 'replay' (it ends a replay), 'no_schedule', or 'no_date' (also for null text). Each mention of the
    day looks back 240 characters, 140 for a replay; the first live mention decides, then any replay."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    months = F.array(*[F.lit(m[:3]) for m in MONTHS])
    found = F.regexp_extract_all(lower, F.lit(SPOKEN), F.lit(0))
    pieces = F.split(F.regexp_replace(lower, SPOKEN, "\x00"), "\x00")

    def verdict(date: Column, i: Column) -> Column:
        year = F.regexp_extract(date, SPOKEN, 3)
        month = F.array_position(months, F.substring(F.regexp_extract(date, SPOKEN, 1), 1, 3))
        parsed = F.try_to_date(F.concat_ws("-", F.when(year == "", F.year(day).cast("string")).otherwise(year), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(date, SPOKEN, 2), 2, "0")), "yyyy-MM-dd")
        lead = F.aggregate(F.sequence(F.lit(0), i), F.lit(""), lambda acc, k: F.right(F.concat(acc, F.when(k > 0, F.get(found, k - 1)).otherwise(""), F.get(pieces, k)), F.lit(240)))
        plan = F.regexp_extract(lead, rf"(?s).*((?:{CALLS}).*)", 1)
        live = (plan != "") & ~plan.rlike(OTHER_MEETINGS) & lead.rlike(SCHEDULE)
        return F.when(parsed.isNull() | (parsed != day), "no_date").when(F.right(lead, F.lit(140)).rlike(REPLAY), "replay").when(live & (year != ""), "live").when(live, "live_year_implied").otherwise("no_schedule")

    found_verdicts = F.transform(found, verdict)
    said = F.get(F.filter(found_verdicts, lambda v: v.startswith("live")), F.lit(0))
    seen = lambda v: F.when(F.array_contains(found_verdicts, v), v)
    return F.coalesce(said, seen("replay"), seen("no_schedule"), F.lit("no_date"))


def reused_names(spans: DataFrame, *, name: str, entity: str, start: str, end: str) -> DataFrame:
    """(name, entity, others): entities whose span of a name overlaps another entity's span of it."""
    a, b = spans.select(name, entity, start, end), spans.select(F.col(name).alias("__name"), F.col(entity).alias("other"), F.col(start).alias("__s"), F.col(end).alias("__e"))
    hit = overlapping(a, b, on=[(name, "__name")], left_span=(start, end), right_span=("__s", "__e")).where(F.col(entity) != F.col("other"))
    return hit.groupBy(name, entity).agg(F.array_join(F.transform(F.sort_array(F.collect_set("other")), lambda x: x.cast("string")), ";").alias("others"))


def fiscal_quarter(report_end: Column, year_end: Column, *, days: int = 35) -> DataFrame | Column:
    """The fiscal quarter whose anniversary (the year's end less 0, 3, 6 or 9 months) is nearest to a date within
    so many days: struct(quarter, expected, distance), or null; ties to the earlier anniversary."""
    tries = F.array(*[F.struct(F.abs(F.datediff(report_end, F.add_months(year_end, -3 * back))).alias("distance"), F.add_months(year_end, -3 * back).alias("expected"), F.lit(4 - back).alias("quarter")) for back in range(4)])
    return F.array_min(F.filter(tries, lambda x: x.distance <= days))

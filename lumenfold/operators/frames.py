"""Shapes of tables and labels of rows: columns by rule, unions of unlike tables, complete cases, periods, statuses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.values import finite
from lumenfold.operators.records import ContractError

#: Texts that stand for no transcript, and marks of one that was cut.
NOT_TRANSCRIPTS = ["transcript has been redacted", "content unavailable", "access denied", "copyright infringement", "this transcript is not available"]
CUT_MARKS = ["[truncated]", "transcript truncated", "content cut off"]
#: A transcript has at least so many words and speakers.
LEAST_WORDS, LEAST_SPEAKERS = 150, 2
#: Codes and descriptions of companies without operations.
NON_OPERATING_SIC = ["6722", "6726", "6770"]
NON_OPERATING = r"(?i)unit investment trust|investment offices|blank checks"


def columns_of(df: DataFrame, *, names: Sequence[str] | None = None, prefix: str | tuple[str, ...] = (), suffix: str | tuple[str, ...] = (), drop: bool = False) -> DataFrame:
    """The columns that are named or have one of the prefixes or suffixes, in the table's order (``drop``: all others). A name that
    isn't there, or no column at all, is a ContractError; with names alone they come in the order of the names."""
    if absent := sorted(set(names or []) - set(df.columns)):
        raise ContractError(f"columns are missing: {absent}")
    ends = lambda given: (given,) if isinstance(given, str) else tuple(given)
    hit = [c for c in df.columns if c in (names or []) or c.startswith(ends(prefix)) or c.endswith(ends(suffix))]
    kept = [c for c in df.columns if c not in hit] if drop else list(names) if names and not prefix and not suffix else hit
    if not kept:
        raise ContractError("no column is left")
    return df.select(*[F.col(f"`{c}`") for c in kept])


def stacked(tables: Sequence[DataFrame], *, fields: Sequence[str] | None = None) -> DataFrame:
    """All rows of the tables; columns are those of the first and then of each next one that are new (or ``fields``), null where a
    table has none. A column of two types is a ContractError, as nothing is cast in silence."""
    types: dict[str, str] = {}
    for df in tables:
        for f in df.schema:
            if types.setdefault(f.name, f.dataType.simpleString()) != f.dataType.simpleString():
                raise ContractError(f"{f.name} is {types[f.name]} and {f.dataType.simpleString()}")
    if absent := [c for c in fields or [] if c not in types]:
        raise ContractError(f"no table has {absent}")
    wanted = list(fields or types)
    out = None
    for df in tables:
        part = df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast(types[c]).alias(c) for c in wanted])
        out = part if out is None else out.union(part)
    return out


def is_true(text: Column, words: Sequence[str] = ("True",)) -> Column:
    """Whether a cell's text is one of the words exactly; null and all else are false."""
    return F.coalesce(text.cast("string").isin(list(words)), F.lit(False))


def with_missing(df: DataFrame, columns: Sequence[str], conditions: Mapping[str, Column] | None = None) -> DataFrame:
    """``df`` with missing: the columns that are null, blank, or no finite number, then the names of conditions that don't hold."""
    types, checks = dict(df.dtypes), []
    for c in columns:
        col = F.col(f"`{c}`")
        there = finite(col) if types[c] in ("double", "float") else F.trim(col) != "" if types[c] == "string" else col.isNotNull()
        checks.append((c, there))
    checks += list((conditions or {}).items())
    return df.withColumn("missing", F.array_compact(F.array(*[F.when(~F.coalesce(there, F.lit(False)), name) for name, there in checks])))


def complete_cases(df: DataFrame, columns: Sequence[str], conditions: Mapping[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of which nothing is missing, the others with missing); see with_missing."""
    judged = with_missing(df, columns, conditions)
    return judged.where(F.size("missing") == 0).drop("missing"), judged.where(F.size("missing") > 0)


def study_place(label: Column, first: str, last: str) -> Column:
    """before, in, after, or malformed (null too) for a quarter label such as 2010Q1, trimmed and in capitals."""
    said = F.upper(F.trim(label))
    return F.when(~F.coalesce(said.rlike(r"^\d{4}Q[1-4]$"), F.lit(False)), "malformed").when(said < first, "before").when(said > last, "after").otherwise("in")


def split_at_study(df: DataFrame, label: str, first: str, last: str) -> tuple[DataFrame, DataFrame]:
    """(rows in the period, rows after it): what is before it or malformed is a ContractError with counts, so it is never removed."""
    placed = df.withColumn("__place", study_place(F.col(label), first, last))
    wrong = placed.where(F.col("__place").isin("before", "malformed")).groupBy("__place").count().collect()
    if wrong:
        raise ContractError("; ".join(f"{r['count']} rows: {r['__place']}" for r in sorted(wrong, key=lambda r: r["__place"])))
    return placed.where("__place = 'in'").drop("__place"), placed.where("__place = 'after'").drop("__place")


def zero_flip(before: Column, after: Column) -> Column:
    """How a score that is not negative moved from or to zero; null if either is null or not a number."""
    known = before.isNotNull() & after.isNotNull() & ~F.isnan(before.cast("double")) & ~F.isnan(after.cast("double"))
    label = F.when((before == 0) & (after > 0), "zero_to_positive").when((before > 0) & (after == 0), "positive_to_zero").when((before == 0) & (after == 0), "zero_in_both").otherwise("positive_in_both")
    return F.when(known, label)


def operating_exclusion(sic: Column, description: Column) -> Column:
    """Why a company has no operations: its code, else its description; "" if neither says so."""
    return F.when(sic.isin(NON_OPERATING_SIC), F.concat(F.lit("non_operating_sic_"), sic)).when(description.rlike(NON_OPERATING), "non_operating_sic_description").otherwise("")


def first_mark(text: Column, marks: Sequence[str]) -> Column:
    """The first of the marks, in their order, that the lower-cased text holds; null if none."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*[F.when(F.contains(lower, F.lit(m)), m) for m in marks], F.lit(None).cast("string"))


def _cases(rules: Sequence[tuple[Column, str, Column | str]], other: tuple[str, str]) -> Column:
    """struct (classification, reason) of the first rule that holds; a null condition doesn't."""
    as_column = lambda r: r if isinstance(r, Column) else F.lit(r)
    label, reason = F.lit(other[0]), F.lit(other[1])
    for condition, name, why in reversed(rules):
        label, reason = F.when(condition, name).otherwise(label), F.when(condition, as_column(why)).otherwise(reason)
    return F.struct(label.alias("classification"), reason.alias("reason"))


def payload_class(
    *, exists: Column, parse_error: Column, verified: Column, provider_class: Column, provider_reason: Column, words: Column, speakers: Column, placeholder: Column, cut: Column,
    payload_symbol: Column, symbol: Column, payload_quarter: Column, quarter: Column, ticker_conflict: Column, issuer_named: Column,
) -> Column:
    """struct (classification, reason) of a collected payload: technical_failure, quarantine, no_transcript, invalid_content,
    identity_mismatch or valid, by the first rule that holds. Nulls are false, empty, or no words."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    text = lambda c: F.coalesce(c, F.lit(""))
    words, speakers = F.coalesce(words, F.lit(0)), F.coalesce(speakers, F.lit(0))
    empty = words == 0
    rules = [
        (~yes(exists) | ((text(parse_error) != "") & empty), "technical_failure", F.concat(F.lit("unreadable or missing payload: "), text(parse_error))),
        (~yes(verified), "quarantine", "raw payload sha256 does not match the recorded collection hash"),
        (text(provider_class).isin("provider_or_http_failure", "transport_error") & empty, "technical_failure", F.when(text(provider_reason) != "", provider_reason).otherwise(provider_class)),
        (empty & (text(provider_class) == "no_transcript"), "no_transcript", "provider returned no substantive transcript"),
        (empty, "technical_failure", "empty payload without a routine no-transcript status"),
        (text(placeholder) != "", "invalid_content", F.concat(F.lit("confirmed non-transcript marker: "), placeholder)),
        ((text(payload_symbol) != "") & (payload_symbol != F.upper(text(symbol))), "identity_mismatch", F.concat(F.lit("payload symbol "), payload_symbol, F.lit(" differs from requested ticker"))),
        ((text(payload_quarter) != "") & (payload_quarter != text(quarter)), "identity_mismatch", F.concat(F.lit("payload quarter "), payload_quarter, F.lit(" differs from requested quarter"))),
        ((text(cut) != "") | (words < LEAST_WORDS) | (speakers < LEAST_SPEAKERS), "quarantine", F.when(text(cut) != "", cut).otherwise("content is too short or structurally incomplete")),
        (yes(ticker_conflict) & ~yes(issuer_named), "quarantine", "ticker reuse overlaps another CIK and issuer text does not resolve it"),
        (~yes(issuer_named), "valid", "request identity agrees; issuer name is not explicit in opening text"),
    ]
    return _cases(rules, ("valid", "structural content and request identity checks passed"))


def response_class(status: Column, payload: Column, has_segments: Column) -> Column:
    """What a provider's answer is: http_error_<code>, rate_limited, information, api_error (a key of the JSON object ``payload``,
    even of null), success or no_transcript. A null status is http_error_none; a payload that is no object has no keys."""
    keys = F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>"))
    has = lambda k: F.array_contains(keys, k)
    out = F.when(status.isNull(), "http_error_none").when(status != 200, F.concat(F.lit("http_error_"), status)).when(has("Note"), "rate_limited").when(has("Information"), "information")
    return out.when(has("Error Message"), "api_error").when(F.coalesce(has_segments, F.lit(False)), "success").otherwise("no_transcript")

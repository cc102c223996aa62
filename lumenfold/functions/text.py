"""Tokenizers, normalisation and text flags as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words with inner apostrophes, full stops and hyphens; what the scorer counts.
SCORER_WORD = r"[A-Za-z0-9]+(?:['’.\-][A-Za-z0-9]+)*"
#: Marks of texts that stand for an absent one.
PLACEHOLDERS = ["transcript not available", "no transcript", "content unavailable"]
LEAST_TOKENS, LEAST_DISTINCT = 1000, 0.10


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({pattern})"), F.lit(1))


def scorer_tokens(text: Column) -> Column:
    """Lower-cased words; hyphenated words stay whole."""
    return F.transform(_all(text, SCORER_WORD), F.lower)


def corpus_tokens(text: Column) -> Column:
    """Runs of letters with hyphens joined away (``mid-cap`` is ``midcap``); stop words stay."""
    return _all(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<=[A-Za-z])-(?=[A-Za-z])", "")), "[a-z]+")


def content_tokens(text: Column, stop_words: list[str]) -> Column:
    """Runs of letters without stop words."""
    stops = F.array(*[F.lit(w) for w in stop_words])
    return F.filter(_all(F.lower(text), "[a-z]+"), lambda w: ~F.array_contains(stops, w))


def alnum_normal(text: Column) -> Column:
    return F.array_join(_all(F.lower(text), "[a-z0-9]+"), " ")


def word_count(text: Column) -> Column:
    return F.size(_all(text, r"\S+"))


def distinct_ratio(tokens: Column) -> Column:
    return F.when(F.size(tokens) > 0, F.size(F.array_distinct(tokens)) / F.size(tokens)).otherwise(0.0)


def integrity_flags(text: Column, tokens: Column, *, least: int = LEAST_TOKENS, ratio: float = LEAST_DISTINCT, markers: list[str] | None = None) -> Column:
    """Flags of a text that cannot be one, in a fixed order, joined by ';'."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    marked = F.lit(False)
    for m in PLACEHOLDERS if markers is None else markers:
        marked = marked | F.contains(lower, F.lit(m))
    flags = F.array(F.when(marked, "placeholder"), F.when((F.size(tokens) > 0) & (distinct_ratio(tokens) < ratio), "repetitive"), F.when(F.size(tokens) < least, "short"))
    return F.array_join(F.array_compact(flags), ";")


def integrity_status(text: Column, tokens: Column, **limits) -> Column:
    """no_transcript_text, content_absent or ok; the order decides."""
    return F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) == 0, "no_transcript_text").when(integrity_flags(text, tokens, **limits) != "", "content_absent").otherwise("ok")


def company_key(name: Column, suffixes: list[str]) -> Column:
    """Words of a company name without legal suffixes, in order."""
    drop = F.array(*[F.lit(s) for s in suffixes])
    return F.array_join(F.filter(_all(F.lower(name), "[a-z0-9]+"), lambda w: ~F.array_contains(drop, w)), " ")


def visible_text(html: Column) -> Column:
    """Markup to text by replacement: scripts and styles go, tags become spaces, the common references decode."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for ref, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(ref), F.lit(char))
    return F.trim(F.regexp_replace(t, r"[ \t\r\n]+", " "))


def links(html: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'href="([^"]*)"'), F.lit(1))


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title>(.*?)</title>", 1))


def inflections(term: Column) -> Column:
    """Regular singular and plural forms of a term's last word, itself included; never the stem of another word."""
    head, last = F.regexp_extract(term, r"^(.*?)(\S+)$", 1), F.regexp_extract(term, r"^(.*?)(\S+)$", 2)
    cut = lambda n: F.substring(last, F.lit(1), F.length(last) - n)
    where = lambda rule, form: F.when(rule, F.array(form)).otherwise(F.array().cast("array<string>"))
    plural = F.concat(F.array(F.concat(last, F.lit("s"))), where(last.rlike("[^aeiou]y$") & (F.length(last) > 2), F.concat(cut(1), F.lit("ies"))), where(last.rlike("(s|x|z|ch|sh)$"), F.concat(last, F.lit("es"))))
    other = (
        F.when(F.endswith(last, F.lit("ies")) & (F.length(last) > 4), F.array(F.concat(cut(3), F.lit("y"))))
        .when(last.rlike("(ses|xes|zes|ches|shes)$"), F.array(cut(2)))
        .when(F.endswith(last, F.lit("s")) & ~F.endswith(last, F.lit("ss")), F.array(cut(1)))
        .otherwise(plural)
    )
    return F.when(last == "", F.array(term)).otherwise(F.array_distinct(F.concat(F.array(term), F.transform(other, lambda w: F.concat(head, w)))))


def context(tokens: Column, start: Column, end: Column, width: int = 12) -> Column:
    """The tokens around a span, so many to either side; positions count from 0."""
    lo = F.greatest(start - width, F.lit(0))
    return F.array_join(F.slice(tokens, lo + 1, end + width + 1 - lo), " ")


def letter_words(text: Column) -> Column:
    """Runs of ASCII letters in lower case; null is no words."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z]+)"), F.lit(1)), F.lower)


def rough_stem(word: Column) -> Column:
    """A suffix stripper for probes: -ing or -ed off a stem of three letters, then -ies to -y, -sses to -ss, or a last -s."""
    verb = F.regexp_replace(word, "^(.{3,})(?:ing|ed)$", "$1")
    return F.when(verb.rlike("^.{2,}ies$"), F.regexp_replace(verb, "ies$", "y")).when(verb.rlike("^.{2,}[^s]s$"), F.regexp_replace(verb, "(?<=.ss)es$|s$", "")).otherwise(verb)

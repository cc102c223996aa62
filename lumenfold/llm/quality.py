"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Four signals of a text are whole numbers of thousandths. For every stratum and signal, labelled good documents are
counted by value; a cutoff may be used if the exact binomial bound shows that documents like them are
rejected at a rate of at most ALPHA / signals with confidence 1 - DELTA / (strata x signals): Bonferroni over
the families, fixed-sequence testing from the laxest cutoff within one. Of the cutoffs that pass, the one
that best tells bad from good is taken; if none passes or helps, the stratum has no cutoff for the signal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, empty_if_null, materialize, small

SIGNALS = ["symbols", "dup_lines", "repeats", "word_length"]
#: Share of good documents that all cutoffs of a stratum together may reject.
ALPHA = 0.05
#: Chance that any stratum exceeds it.
DELTA = 0.05
#: A good document's rejection weighs as much as that of so many bad ones, by share.
PENALTY = 5
SPACE = r"[\x20\x09-\x0D]+"


def _thousandths(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.least(F.floor(1000 * part / whole), F.lit(1000))).otherwise(0).cast("int")


def text_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the base columns and signals of the whole text to ``docs``; a null text has no words.

    Repeated three-word windows are found within the row: window hashes are sorted with their places, equal
    neighbours keep their places, and the places' windows are united.
    """
    df = docs.withColumn("__t", empty_if_null(text_col))
    df = df.withColumn("__w", F.array_remove(F.split("__t", SPACE), ""))
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike(WORD))
    df = df.withColumn("n_words", F.size("__w").cast("bigint")).withColumn("__l", lines)
    w = F.col("__w")
    df = df.withColumn("word_chars", F.length(F.array_join("__w", "")).cast("bigint"))
    df = df.withColumn("n_symbols", F.length(F.regexp_replace("__t", r"[^#*$%&|<>]+", "")).cast("bigint"))
    df = df.withColumn("__lines", F.size("__l").cast("bigint")).withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("bigint"))
    hashes = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("__h", hashes)
    placed = F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    df = df.withColumn("__s", placed)
    s = F.col("__s")
    twice = F.filter(s, lambda x, j: (F.get(s, j - 1).h == x.h) | (F.get(s, j + 1).h == x.h))
    df = df.withColumn("__p", F.sort_array(F.transform(twice, lambda x: x.i)))
    united = F.aggregate("__p", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("last")), lambda a, p: F.struct((a.n + F.least(F.lit(3), p - a.last)).alias("n"), p.alias("last")), lambda a: a.n)
    df = df.withColumn("n_repeat_words", united)
    df = df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    df = df.withColumn("symbols", _thousandths(F.col("n_symbols"), F.col("word_chars")))
    df = df.withColumn("dup_lines", _thousandths(F.col("n_dup_lines"), F.col("__lines")))
    df = df.withColumn("repeats", _thousandths(F.col("n_repeat_words"), F.col("n_words")))
    df = df.withColumn("word_length", F.when(F.col("n_words") > 0, F.least(F.floor(10 * F.col("word_chars") / F.col("n_words")), F.lit(1000))).otherwise(0).cast("int"))
    return df.drop("__t", "__w", "__l", "__h", "__s", "__p", "__lines")


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p): the terms by recursion on their logarithms."""
    odds, none = F.log(F.lit(p / (1 - p))), n * F.log(F.lit(1 - p))
    start = F.struct(none.alias("term"), F.exp(none).alias("sum"))

    def add(a: Column, i: Column) -> Column:
        term = a.term + F.log((n - i + 1) / i) + odds
        return F.struct(term.alias("term"), (a.sum + F.exp(term)).alias("sum"))

    return F.when(k < 1, F.exp(none)).otherwise(F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.greatest(k, F.lit(1).cast("bigint"))), start, add, lambda a: a.sum))


def cutoffs(features: DataFrame, labels: DataFrame, *, id_col: str, stratum_col: str) -> DataFrame:
    """(stratum, one column a signal): values above it are rejected; null: no cutoff. Labels without a
    document, of other qualities than 0 and 1, or of documents that fail the base rules, do not count."""
    known = labels.where("quality in (0, 1)").groupBy(F.col("doc_id").alias("label_id")).agg(F.max("quality").alias("quality"))
    rows = features.where(~F.col("base_failed")).select(F.col(id_col).alias("label_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), *SIGNALS)
    stacked = rows.join(known, "label_id").select("stratum", "quality", F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).alias("value")) for s in SIGNALS])).alias("x"))
    counts = stacked.groupBy("stratum", "x.signal", "x.value").agg(F.sum(F.col("quality").cast("bigint")).alias("good"), F.sum((1 - F.col("quality")).cast("bigint")).alias("bad"))
    counts = materialize(counts, "labelled")  # a row for each of 1,001 values at most
    families = max(1, counts.select("stratum", "signal").distinct().count())
    above = Window.partitionBy("stratum", "signal").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("stratum", "signal")
    tried = counts.select(
        "stratum", "signal", "value",
        F.coalesce(F.sum("good").over(above), F.lit(0)).alias("k"), F.coalesce(F.sum("bad").over(above), F.lit(0)).alias("hit"),
        F.sum("good").over(whole).alias("n"), F.sum("bad").over(whole).alias("n_bad"),
    )
    rate = ALPHA / len(SIGNALS)
    safe = F.when(F.col("k") >= rate * F.col("n"), False).otherwise(binomial_cdf(F.col("k"), F.col("n"), rate) <= DELTA / families)
    gain = F.col("hit") * F.col("n") - PENALTY * F.col("k") * F.col("n_bad")
    best = tried.where(safe & (gain > 0)).groupBy("stratum", "signal").agg(F.max_by("value", F.struct(gain, "value")).alias("value"))
    return best.groupBy("stratum").agg(*[F.max(F.when(F.col("signal") == s, F.col("value"))).alias(f"{s}_cutoff") for s in SIGNALS])


def judged(features: DataFrame, limits: DataFrame, *, stratum_col: str) -> DataFrame:
    """Adds ``kept`` by the base rules and the stratum's cutoffs."""
    limits = limits.withColumnRenamed("stratum", "__stratum")
    df = features.withColumn("__own", F.coalesce(F.col(stratum_col).cast("string"), F.lit(""))).join(small(limits), F.col("__own") == F.col("__stratum"), "left")
    over = F.lit(False)
    for s in SIGNALS:
        over = over | F.coalesce(F.col(s) > F.col(f"{s}_cutoff"), F.lit(False))
    return df.withColumn("kept", ~F.col("base_failed") & ~over).drop("__own", "__stratum", *[f"{s}_cutoff" for s in SIGNALS])


def quality_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every row.

    A null text has no words and fails the base rules; a null stratum counts as ''. Repeated rows are judged
    each for itself, by the same label. Without labels (or with too few to prove a cutoff) only the base rules
    reject. Other columns are not read; an empty table gives no rows.
    """
    features = materialize(text_features(docs.select(id_col, stratum_col, text_col), text_col).drop(text_col), "features")
    limits = materialize(cutoffs(features, labels, id_col=id_col, stratum_col=stratum_col), "cutoffs")
    return judged(features, limits, stratum_col=stratum_col).select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that quality_rules keeps, with their columns. Cutoffs come from narrow features;
    the texts are judged again in place and never shuffled."""
    own = docs.select([F.col(c) for c in docs.columns])
    narrow = materialize(text_features(docs.select(id_col, stratum_col, text_col), text_col).drop(text_col), "features")
    limits = materialize(cutoffs(narrow, labels, id_col=id_col, stratum_col=stratum_col), "cutoffs")
    packed = own.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(stratum_col).alias("__stratum_value"), F.col(text_col).alias("__text"))
    # the row number keeps the filter above the features: pushed below, it would repeat them for every element
    features = text_features(packed, "__text").withColumn("__n", F.monotonically_increasing_id())
    return judged(features, limits, stratum_col="__stratum_value").where(F.col("kept") & (F.col("__n") >= 0)).select("__row.*")


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Base rules and risk-controlled cutoffs on every document."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def features_sql(docs: str = "documents") -> str:
    """CTEs in DuckDB's SQL that end in ``feat``: a row for each row of ``docs``."""
    return rf"""
    src AS (SELECT *, row_number() OVER () AS rid, coalesce(text, '') AS t FROM {docs}),
    ws AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM src),
    grams AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM ws WHERE len(w) >= 3)),
    twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c > 1),
    cover AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
    base AS (SELECT src.*, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
        FROM src JOIN ws USING (rid) LEFT JOIN cover USING (rid)),
    feat AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(lang, '') AS stratum,
        CASE WHEN word_chars > 0 THEN least(1000 * n_symbols // word_chars, 1000) ELSE 0 END AS symbols,
        CASE WHEN n_lines > 0 THEN least(1000 * n_dup_lines // n_lines, 1000) ELSE 0 END AS dup_lines,
        CASE WHEN n_words > 0 THEN least(1000 * n_repeat_words // n_words, 1000) ELSE 0 END AS repeats,
        CASE WHEN n_words > 0 THEN least(10 * word_chars // n_words, 1000) ELSE 0 END AS word_length FROM base)"""


def verdict_sql(docs: str = "documents") -> str:
    """CTEs that end in ``verdict``: features with ``kept``."""
    rate = ALPHA / len(SIGNALS)
    stacked = " UNION ALL ".join(f"SELECT stratum, quality, '{s}' AS signal, {s} AS value FROM labelled" for s in SIGNALS)
    over = " OR ".join(f"coalesce({s} > (SELECT value FROM best b WHERE b.stratum = feat.stratum AND b.signal = '{s}'), false)" for s in SIGNALS)
    return f"""{features_sql(docs)},
    known AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
    labelled AS (SELECT feat.*, quality FROM feat JOIN known USING (doc_id) WHERE NOT base_failed),
    stacked AS ({stacked}),
    counts AS (SELECT stratum, signal, value, sum(quality)::BIGINT AS good, sum(1 - quality)::BIGINT AS bad FROM stacked GROUP BY ALL),
    tried AS (SELECT stratum, signal, value,
        coalesce(sum(good) OVER (PARTITION BY stratum, signal ORDER BY value DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS k,
        coalesce(sum(bad) OVER (PARTITION BY stratum, signal ORDER BY value DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS hit,
        (sum(good) OVER (PARTITION BY stratum, signal))::BIGINT AS n, (sum(bad) OVER (PARTITION BY stratum, signal))::BIGINT AS n_bad,
        (SELECT count(*) FROM (SELECT DISTINCT stratum, signal FROM counts)) AS families FROM counts),
    gains AS (SELECT *, hit * n - {PENALTY} * k * n_bad AS gain FROM tried WHERE k < {rate!r} * n),
    terms AS (SELECT stratum, signal, value, exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({rate!r}) + (n - i) * ln(1 - {rate!r})) AS p
        FROM (SELECT *, unnest(range(0, k + 1)) AS i FROM gains WHERE gain > 0)),
    passed AS (SELECT gains.* FROM gains JOIN (SELECT stratum, signal, value, sum(p) AS p FROM terms GROUP BY ALL) c USING (stratum, signal, value) WHERE p <= {DELTA!r} / families),
    best AS (SELECT stratum, signal, value FROM passed QUALIFY row_number() OVER (PARTITION BY stratum, signal ORDER BY gain DESC, value DESC) = 1),
    verdict AS (SELECT *, NOT base_failed AND NOT ({over}) AS kept FROM feat)"""


OP7_SQL = f"WITH {verdict_sql()} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM verdict"

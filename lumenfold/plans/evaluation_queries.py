"""Queries that judge methods: the terms of one corpus sought in another, and blinded reviews of documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenfold.operators import evaluation as E
from lumenfold.plans.table_queries import table

LISTED, LONGEST, LEAST, PER_METHOD, SALT = 200, 300, 25, 60, "review"


def _words(spark, sf_dir, name, *keys):
    words = F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), F.lower)
    return table(spark, sf_dir, name).select(*keys, F.explode(words).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("n"))


def discrepancy_classes(spark, sf_dir):
    """The most frequent words of conversations, sought in each language's ranked words of the documents: a language is
    a method, which drops words of three letters or less after ranking; English is the one that is judged."""
    order = Window.orderBy(F.desc("n"), "term")
    published = _words(spark, sf_dir, "conversations").orderBy(F.desc("n"), "term").limit(LISTED).withColumn("place", F.row_number().over(order)).drop("n")
    words = _words(spark, sf_dir, "documents", "lang").where("lang is not null")
    ranked = words.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "term"))).where(F.col("rank") <= LONGEST).select(F.col("lang").alias("method"), "term", "rank")
    counts = words.groupBy("term").agg(F.sum("n").alias("frequency"), (F.count("*") > 1).alias("in_vocabulary"))
    return E.discrepancies(published, ranked.where("length(term) > 3"), ranked, counts, method="en", least=LEAST)


DISCREPANCIES = f"""WITH c AS (SELECT lower(w) AS term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM conversations) GROUP BY 1), p AS (SELECT term, row_number() OVER (ORDER BY n DESC, term)::INT AS place FROM c QUALIFY place <= {LISTED}),
w AS (SELECT lang, lower(w) AS term, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents WHERE lang IS NOT NULL) GROUP BY 1, 2),
r AS (SELECT lang, term, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term)::INT AS rank FROM w QUALIFY rank <= {LONGEST}), f AS (SELECT term, count(*) AS methods, bool_or(lang = 'en') AS own FROM r WHERE length(term) > 3 GROUP BY term), t AS (SELECT term, sum(n)::BIGINT AS frequency, count(*) > 1 AS known FROM w GROUP BY term),
j AS (SELECT p.term, place, coalesce(own, false) AS recovered, r.rank AS best_rank, coalesce(frequency, 0) AS frequency, coalesce(methods, 0) AS methods, CASE WHEN own THEN 'recovered' WHEN frequency IS NULL THEN 'absent' WHEN frequency < {LEAST} THEN 'below_least' WHEN NOT known THEN 'out_of_vocabulary'
    WHEN r.rank IS NOT NULL THEN 'dropped_after_ranking' WHEN methods IS NULL THEN 'missed_by_all' ELSE 'found_by_others' END AS reason FROM p LEFT JOIN f USING (term) LEFT JOIN t USING (term) LEFT JOIN r ON r.term = p.term AND r.lang = 'en')
SELECT *, CASE reason WHEN 'recovered' THEN '' WHEN 'dropped_after_ranking' THEN 'preprocessing' WHEN 'missed_by_all' THEN 'proprietary_algorithm' WHEN 'found_by_others' THEN 'model' ELSE 'corpus' END AS discrepancy_class FROM j"""


def blinded_precision(spark, sf_dir):
    """Precision of four ways to pick good documents, by a blinded sheet that the labels fill in: good and not toxic
    is relevant, good and toxic borderline; documents without labels stay blank."""
    docs = table(spark, sf_dir, "documents")
    ways = {"english": F.col("lang") == "en", "long": F.col("n_chars") >= 1500, "stops": F.length("text") - F.length(F.regexp_replace("text", r"\.", "")) >= 10, "rare_source": F.col("source").isNull()}
    picked = docs.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(c, name) for name, c in ways.items()]))).alias("method"))
    sheet, key = E.blinded_review(picked, method="method", item="doc_id", per_method=PER_METHOD, salt=SALT)
    word = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "relevant").when(F.col("quality") == 1, "borderline").otherwise("not_relevant")
    judged = sheet.join(table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(word).alias("judgement")), "doc_id", "left")
    out = E.review_precision(judged.select("review_id", "judgement"), key, method="method")
    return out.select("method", "drawn", "reviewed", *E.JUDGEMENTS, F.round("precision_strict", 4).alias("precision_strict"), F.round("precision_lenient", 4).alias("precision_lenient"))


BLINDED = f"""WITH m AS (SELECT doc_id, unnest(['english', 'long', 'stops', 'rare_source']) AS method, unnest([lang = 'en', n_chars >= 1500, length(text) - length(replace(text, '.', '')) >= 10, source IS NULL]) AS hit FROM documents),
d AS (SELECT doc_id, method FROM m WHERE hit QUALIFY row_number() OVER (PARTITION BY method ORDER BY sha256('{SALT}|' || doc_id::VARCHAR), doc_id) <= {PER_METHOD}),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 AND toxic = 0 THEN 'relevant' WHEN quality = 1 THEN 'borderline' ELSE 'not_relevant' END) AS j FROM labels GROUP BY doc_id),
s AS (SELECT method, count(*) AS drawn, count(j) AS reviewed, count(*) FILTER (j = 'relevant') AS relevant, count(*) FILTER (j = 'borderline') AS borderline, count(*) FILTER (j = 'not_relevant') AS not_relevant FROM d LEFT JOIN l USING (doc_id) GROUP BY method)
SELECT *, round(relevant / nullif(reviewed, 0), 4) AS precision_strict, round((relevant + borderline) / nullif(reviewed, 0), 4) AS precision_lenient FROM s"""

QUERIES = {"discrepancy_classes": discrepancy_classes, "blinded_precision": blinded_precision}
ORACLES = {"discrepancy_classes": DISCREPANCIES, "blinded_precision": BLINDED}

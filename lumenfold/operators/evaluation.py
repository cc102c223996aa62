"""Evaluation of methods: why a published term was not found, and precision by a review that hides the method."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.ranks import positions
from lumenfold.operators.records import ContractError
from lumenfold.operators.sampling import draw_order, reservoir
from lumenfold.sources.storage import materialize

# What a reviewer may write
JUDGEMENTS = ["relevant", "borderline", "not_relevant"]


def discrepancies(published: DataFrame, finals: DataFrame, ranked: DataFrame, counts: DataFrame, *, method: str, least: int) -> DataFrame:
    """Each row of ``published`` (term, ...) with recovered, best_rank, frequency, methods, reason and discrepancy_class.

    ``finals`` (method, term) are the lists that the methods kept, ``ranked`` (method, term, rank) their candidates,
    ``counts`` (term, frequency, in_vocabulary) the corpus. The first that holds: recovered (no class); absent,
    below_least and out_of_vocabulary (corpus); dropped_after_ranking (preprocessing); missed_by_all
    (proprietary_algorithm); found_by_others (model). Repeated rows of a list count once; null terms are absent.
    """
    kept = finals.groupBy(F.col("term").alias("__f")).agg(F.count_distinct("method").alias("methods"), F.max((F.col("method") == method).cast("int")).alias("__own"))
    best = ranked.where(F.col("method") == method).groupBy(F.col("term").alias("__r")).agg(F.min("rank").alias("best_rank"))
    corpus = counts.groupBy(F.col("term").alias("__c")).agg(F.sum("frequency").alias("frequency"), F.max("in_vocabulary").alias("__in"))
    out = published
    for side, name in ((kept, "__f"), (best, "__r"), (corpus, "__c")):
        out = out.join(side, F.col("term") == F.col(name), "left")
    own, seen = F.coalesce(F.col("__own") == 1, F.lit(False)), F.coalesce("frequency", F.lit(0))
    reason = (
        F.when(own, "recovered").when(seen == 0, "absent").when(seen < least, "below_least").when(~F.coalesce("__in", F.lit(False)), "out_of_vocabulary")
        .when(F.col("best_rank").isNotNull(), "dropped_after_ranking").when(F.col("methods").isNull(), "missed_by_all").otherwise("found_by_others")
    )
    classes = {"absent": "corpus", "below_least": "corpus", "out_of_vocabulary": "corpus", "dropped_after_ranking": "preprocessing", "missed_by_all": "proprietary_algorithm", "found_by_others": "model"}
    named = F.coalesce(*[F.when(F.col("reason") == r, c) for r, c in classes.items()], F.lit(""))
    out = out.select(*[F.col(f"`{c}`") for c in published.columns], own.alias("recovered"), "best_rank", seen.alias("frequency"), F.coalesce("methods", F.lit(0)).alias("methods"), reason.alias("reason"))
    return out.withColumn("discrepancy_class", named)


def blinded_review(items: DataFrame, *, method: str, item: str, per_method: int, salt: str) -> tuple[DataFrame, DataFrame]:
    """(sheet, key): a sheet (review_id, item) that names no method, and the key (review_id, item, method, seen).

    Each method gives ``per_method`` items of its own by salted hash (all, if fewer); an item that several drew is on
    the sheet once. Ids follow another hash, so they tell nothing of method or order. (method, item) rows are
    unique; null methods and items are not reviewed. Both tables are written, for the key to stay with the sheet.
    """
    drawn = reservoir(items.where(F.col(method).isNotNull() & F.col(item).isNotNull()).select(method, item), [method], item, per_method, salt=salt)
    drawn = materialize(drawn.select(method, item, "seen"), "drawn")
    once = drawn.select(item).distinct().withColumn("__order", draw_order(f"{salt}|sheet", item))
    placed = positions(once, [], [F.col("__order").asc(), F.col(item).asc()], "__place")
    sheet = materialize(placed.select(F.concat(F.lit("R"), F.lpad((F.col("__place") + 1).cast("string"), 9, "0")).alias("review_id"), item), "sheet")
    return sheet, drawn.join(sheet, item).select("review_id", item, method, "seen")


def review_precision(judged: DataFrame, key: DataFrame, *, method: str) -> DataFrame:
    """(method, drawn, reviewed, relevant, borderline, not_relevant, precision_strict, precision_lenient): the filled
    sheet (review_id, judgement) meets its key. Blank or null judgements are not reviewed, and a method without any has null
    precisions; another word, or a review_id twice, is a ContractError."""
    word = F.nullif(F.trim("judgement"), F.lit(""))
    sheet = judged.select(F.col("review_id").alias("__id"), word.alias("__j"))
    bad = sheet.groupBy("__id").agg(F.count("*").alias("n"), F.max(F.coalesce(~F.col("__j").isin(JUDGEMENTS), F.lit(False)).cast("int")).alias("odd")).where("n > 1 or odd = 1").limit(1).collect()
    if bad:
        raise ContractError(f"{bad[0]['__id']}: a judgement is none of {JUDGEMENTS} or the id is repeated")
    both = key.join(sheet, F.col("review_id") == F.col("__id"), "left").groupBy(method).agg(F.count("*").alias("drawn"), F.count("__j").alias("reviewed"), *[F.count_if(F.col("__j") == j).alias(j) for j in JUDGEMENTS])
    share = lambda c: F.when(F.col("reviewed") > 0, c / F.col("reviewed"))
    return both.withColumn("precision_strict", share(F.col("relevant"))).withColumn("precision_lenient", share(F.col("relevant") + F.col("borderline")))

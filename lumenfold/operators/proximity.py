"""Weighted term pairs within a token window.

Occurrences come from one pass over the tokens and a broadcast of the vocabulary (its size is that of a
dictionary). Pairs meet by document and position bucket, so a long document is dealt over many keys; the
band predicate decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.sources.storage import materialize, small

WINDOW = 10


def vocabulary(spark: SparkSession, terms: dict[str, float]) -> DataFrame:
    """(term, words, weight): terms normalised to lower case and single spaces, the largest weight of each."""
    kept: dict[str, float] = {}
    for term, weight in terms.items():
        name = " ".join(term.lower().split())
        if name and (name not in kept or weight > kept[name]):
            kept[name] = float(weight)
    return spark.createDataFrame([(t, t.split(), w) for t, w in sorted(kept.items())], "term string, words array<string>, weight double")


def occurrences(docs: DataFrame, tokens: str, vocab: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """(id, term, weight, s, e): every occurrence with its inclusive token positions; overlaps all count. Only a
    position whose word begins a term leaves its row, with the words of the longest term from there on."""
    words = F.broadcast(vocab.withColumn("first", F.col("words")[0]))
    ends = F.broadcast(vocab.agg(F.max(F.size("words")).alias("__longest"), F.collect_set(F.col("words")[0]).alias("__firsts")))  # one row
    ahead = F.transform(F.col(tokens), lambda w, i: F.when(F.array_contains(F.col("__firsts"), w), F.struct(i.alias("s"), F.slice(F.col(tokens), i + 1, F.col("__longest")).alias("ahead"))))
    placed = docs.crossJoin(ends).select(F.col(id_col).alias("id"), F.explode(F.filter(ahead, lambda x: x.isNotNull())).alias("__p")).select("id", "__p.s", "__p.ahead")
    hit = placed.join(words, F.col("ahead")[0] == F.col("first")).where(F.slice("ahead", F.lit(1), F.size("words")) == F.col("words"))
    return hit.select("id", "term", "weight", "s", (F.col("s") + F.size("words") - 1).alias("e"))


def within(window: int) -> Column:
    """Whether spans (s, e) and (s2, e2) are at most so many tokens apart."""
    return (F.col("s") <= F.col("e2") + window) & (F.col("s2") <= F.col("e") + window)


def _buckets(start: str, end: str, window: int) -> Column:
    """Buckets that a span with its window behind it covers. Two such intervals overlap where the spans are
    within the window; they share the bucket of the later start, whatever the length of a term."""
    width = window + 8
    return F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) + window) / width)))


def _meeting(left: DataFrame, right: DataFrame, window: int) -> tuple[DataFrame, DataFrame, Column]:
    a, b = left.withColumn("bucket", _buckets("s", "e", window)), right.withColumn("bucket2", _buckets("s2", "e2", window))
    return a, b, (F.col("id") == F.col("id2")) & (F.col("bucket") == F.col("bucket2")) & (F.col("bucket") == F.floor(F.greatest("s", "s2") / (window + 8))) & within(window)


def near_pairs(left: DataFrame, right: DataFrame, *, window: int = WINDOW, same_spans: bool = True) -> DataFrame:
    """All pairs of occurrences of a document within the window; the right side's columns end in 2. Spans meet
    by document and position bucket, every pair once, in the bucket of its later start."""
    b = right.select(F.col("id").alias("id2"), F.col("term").alias("term2"), F.col("weight").alias("weight2"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    a, b, meet = _meeting(left, b, window)
    joined = a.join(b, meet).drop("bucket", "bucket2", "id2")
    return joined if same_spans else joined.where((F.col("s") != F.col("s2")) | (F.col("e") != F.col("e2")))


def near_any(left: DataFrame, right: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """The occurrences of ``left`` with any of ``right`` within the window; equal rows count once."""
    a, b, meet = _meeting(left, right.select(F.col("id").alias("id2"), F.col("s").alias("s2"), F.col("e").alias("e2")), window)
    return a.join(b, meet, "left_semi").drop("bucket").distinct()


def raw_scores(docs: DataFrame, tokens: str, supply: DataFrame, risk: DataFrame, resolution: DataFrame, *, id_col: str = "doc_id", window: int = WINDOW, same_spans: bool = True) -> DataFrame:
    """(id, n_tokens, n_pairs, n_resolved, risk, resolved): weights of supply and risk pairs by token; a pair is
    resolved if a resolution term is near its supply span."""
    base = docs.select(F.col(id_col).alias("id"), F.size(tokens).alias("n_tokens"))
    own = occurrences(docs, tokens, supply, id_col=id_col)
    pairs = near_pairs(own, occurrences(docs, tokens, risk, id_col=id_col), window=window, same_spans=same_spans)
    solved = near_any(own, occurrences(docs, tokens, resolution, id_col=id_col), window=window).select("id", "term", "s", F.lit(True).alias("solved"))
    sums = pairs.join(solved, ["id", "term", "s"], "left").groupBy("id").agg(F.count("*").alias("n_pairs"), F.count("solved").alias("n_resolved"), F.sum("weight").alias("w"), F.sum(F.when(F.col("solved"), F.col("weight"))).alias("v"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    per = lambda c: F.when(F.col("n_tokens") > 0, F.coalesce(F.col(c), F.lit(0.0)) / F.col("n_tokens")).otherwise(0.0)
    return base.join(sums, "id", "left").select("id", "n_tokens", zero("n_pairs").alias("n_pairs"), zero("n_resolved").alias("n_resolved"), per("w").alias("risk"), per("v").alias("resolved"))


def scaled(df: DataFrame, cols: list[str], member: Column) -> DataFrame:
    """Adds <col>_scaled for members of the population: the value by the population's standard deviation,
    the mean not subtracted; 0 where the deviation is 0, null outside."""
    stats = df.where(member).agg(*[F.stddev_pop(c).alias(f"__{c}") for c in cols])
    out = df.crossJoin(F.broadcast(stats))  # one row
    for c in cols:
        out = out.withColumn(f"{c}_scaled", F.when(member, F.when(F.coalesce(F.col(f"__{c}"), F.lit(0.0)) == 0, 0.0).otherwise(F.col(c) / F.col(f"__{c}"))))
    return out.drop(*[f"__{c}" for c in cols])


def nearest_distance(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, distance): the fewest tokens between spans of either side, 0 where they touch or overlap. Per
    document the spans are sorted once and each compares with the running extremes before it."""
    from pyspark.sql import Window

    both = left.select("id", "s", "e", F.lit(0).alias("side")).unionByName(right.select("id", "s", "e", F.lit(1).alias("side")))
    order = Window.partitionBy("id").orderBy("s", "e", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    other = F.when(F.col("side") == 0, F.max(F.when(F.col("side") == 1, F.col("e"))).over(order)).otherwise(F.max(F.when(F.col("side") == 0, F.col("e"))).over(order))
    return both.withColumn("gap", F.when(other.isNotNull(), F.greatest(F.col("s") - other, F.lit(0)))).groupBy("id").agg(F.min("gap").alias("distance"))


def family_impact(pairs: DataFrame, families: DataFrame) -> DataFrame:
    """(family, terms, docs, n_pairs, weight, nonzero, became_zero, nonzero_without, weight_without): what is left of
    the documents' pairs without the terms of each family.

    ``pairs`` are (id, term, weight) rows, ``families`` (family, term); families may share terms, and one without pairs
    takes nothing away. Null families and terms are ignored, repeated rows of families count once; without pairs all
    counts are 0. Pairs are summed by document and term before they move, then lie by document for both totals.
    """
    family = families.where("family is not null and term is not null").distinct()
    per = pairs.groupBy("id", "term").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).repartition("id")
    per = materialize(per, "terms")
    total = per.groupBy("id").agg(F.sum("n").alias("n"))
    both = per.select(F.col("id").alias("__id"), "term", F.col("n").alias("m"), "w").join(small(family), "term").groupBy("__id", "family").agg(F.sum("m").alias("m"), F.sum("w").alias("w"))
    hit = both.join(total, F.col("__id") == F.col("id")).groupBy(F.col("family").alias("__f")).agg(F.count("*").alias("docs"), F.sum("m").alias("n_pairs"), F.sum("w").alias("weight"), F.count_if(F.col("m") == F.col("n")).alias("became_zero"))
    everything = per.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("__w")).crossJoin(total.agg(F.count("*").alias("nonzero")))  # one row
    names = family.groupBy("family").agg(F.count("*").alias("terms"))
    out = names.join(hit, F.col("family") == F.col("__f"), "left").crossJoin(F.broadcast(everything))
    zero = lambda c, v=0: F.coalesce(c, F.lit(v))
    return out.select("family", "terms", *[zero(c).alias(c) for c in ("docs", "n_pairs")], zero("weight", 0.0).alias("weight"), "nonzero", zero("became_zero").alias("became_zero"), (F.col("nonzero") - zero("became_zero")).alias("nonzero_without"), (F.col("__w") - zero("weight", 0.0)).alias("weight_without"))


def top_terms(pairs: DataFrame, k: int) -> DataFrame:
    """(id, rank, term, n, weight): the k terms of each document with the largest weight, ties to more pairs, then to
    the smaller term; weights are rounded to nine places, so that no order of sums decides. A document has at most a row for each term of the vocabulary; the limit works before the shuffle too."""
    per = pairs.groupBy("id", "term").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 9).alias("weight"))
    order = Window.partitionBy("id").orderBy(F.desc("weight"), F.desc("n"), "term")
    return per.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("id", "rank", "term", "n", "weight")

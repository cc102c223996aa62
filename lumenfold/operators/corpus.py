"""Corpus statistics, phrases, co-occurrence and vector expansion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.sources.storage import materialize, small

#: Sums of so many terms, a number each, are broadcast; with more of them the joins shuffle.
MOST_TERMS = 100_000
#: Frequent words and phrases of so many at most are broadcast as numbers; documents and pairs that a task holds at a time.
MOST_WORDS, MOST_PHRASES, DOCS, PAIRS = 1_000_000, 2_000_000, 1000, 1_500_000


def term_frequencies(docs: DataFrame, tokens: str, *, id_col: str = "doc_id", least_docs: int = 1) -> DataFrame:
    """(term, tf, df): counted per document first, so the shuffle holds a row for each term of a document."""
    per = docs.select(id_col, F.explode(tokens).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("n"))
    return per.groupBy("term").agg(F.sum("n").alias("tf"), F.count("*").alias("df")).where(F.col("df") >= least_docs)


def bigram_counts(docs: DataFrame, tokens: str) -> DataFrame:
    t = F.col(tokens)
    pairs = F.when(F.size(t) > 1, F.transform(F.sequence(F.lit(1), F.size(t) - 1), lambda i: F.struct(t[i - 1].alias("a"), t[i].alias("b"))))
    return docs.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def frequent_bigrams(docs: DataFrame, tokens: str, *, least: int) -> DataFrame:
    """(a, b, n): pairs of neighbours of at least so many occurrences, as bigram_counts would count them.

    Such a pair's words occur as often, so only pairs of frequent words are counted, as numbers, and a task sums its own
    before the shuffle. The frequent words are broadcast; with more than MOST_WORDS of them pairs are counted by their words.
    """
    words = materialize(docs.select(F.explode(tokens).alias("w")).groupBy("w").agg(F.count("*").alias("c")).where((F.col("c") >= least) & F.col("w").isNotNull()).select("w"), "frequent-words")
    if words.count() > MOST_WORDS:
        return bigram_counts(docs, tokens).where((F.col("n") >= least) & F.col("a").isNotNull() & F.col("b").isNotNull())
    terms = words.orderBy("w").toArrow().column("w").combine_chunks()
    n, known = len(terms), docs.sparkSession.sparkContext.broadcast(terms)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums, held = [], [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            return key, np.bincount(at, np.concatenate(sums), len(key)).astype(np.int64)

        for lists in (batch.column(0).slice(k, DOCS) for batch in it for k in range(0, batch.num_rows, DOCS)):
            ids = pc.fill_null(pc.index_in(lists.flatten(), known.value), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            both = (row[:-1] == row[1:]) & (ids[:-1] >= 0) & (ids[1:] >= 0)
            key, count = np.unique((ids[:-1] * n + ids[1:])[both], return_counts=True)
            keys.append(key)
            sums.append(count)
            held += len(key)
            if held > PAIRS:
                key, total = summed()
                if len(key) > PAIRS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(total)], names=["key", "n"])
                    key, total = key[:0], total[:0]
                keys, sums, held = [key], [total], len(key)
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in summed()], names=["key", "n"])

    counts = docs.select(tokens).mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)

    def named(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            key = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([known.value.take(pa.array(key // n)), known.value.take(pa.array(key % n)), batch.column(1)], names=["a", "b", "n"])

    return counts.mapInArrow(named, "a string, b string, n bigint")


def phrase_scores(docs: DataFrame, tokens: str, *, least: int, threshold: float = 0.0) -> DataFrame:
    """(a, b, n, score): (n - least) * vocabulary / (n_a * n_b) of frequent pairs; counts are exact."""
    words = docs.select(F.explode(tokens).alias("w")).groupBy("w").agg(F.count("*").alias("c"))
    size = words.agg(F.count("*").alias("v"))
    pairs = bigram_counts(docs, tokens).where(F.col("n") >= least)
    both = pairs.join(words.select(F.col("w").alias("a"), F.col("c").alias("ca")), "a").join(words.select(F.col("w").alias("b"), F.col("c").alias("cb")), "b").crossJoin(F.broadcast(size))
    return both.select("a", "b", "n", ((F.col("n") - least) * F.col("v") / (F.col("ca") * F.col("cb"))).alias("score")).where(F.col("score") >= threshold)


def greedy_joins(docs: DataFrame, tokens: str, phrases: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """(id, position, phrase): the pairs that a left-to-right pass joins. In each run of joinable starts a pass
    takes every other one, so a place in its run of even offset is joined: gaps and islands."""
    placed = docs.where(F.size(tokens) > 1).select(id_col, F.posexplode(F.arrays_zip(F.slice(tokens, F.lit(1), F.size(tokens) - 1).alias("a"), F.slice(tokens, F.lit(2), F.size(tokens) - 1).alias("b"))).alias("position", "p"))
    starts = placed.select(id_col, "position", F.col("p.a").alias("a"), F.col("p.b").alias("b")).join(phrases.select("a", "b"), ["a", "b"])
    order = Window.partitionBy(id_col).orderBy("position")
    runs = starts.withColumn("island", F.col("position") - F.row_number().over(order))
    place = F.row_number().over(Window.partitionBy(id_col, "island").orderBy("position"))
    return runs.withColumn("place", place).where(F.col("place") % 2 == 1).select(id_col, "position", F.concat_ws("_", "a", "b").alias("phrase"))


def joined_phrases(docs: DataFrame, tokens: str, phrases: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """(phrase, joins, docs): how often greedy_joins joins each phrase, and in how many ids.

    Rows whose ids are their own are passed over in the row, and a task sums its own phrases before the shuffle; rows that share
    an id, and all of them if there are more than MOST_PHRASES phrases, go through greedy_joins.
    """
    chosen = materialize(phrases.select("a", "b").distinct(), "phrases")

    def slowly(some: DataFrame) -> DataFrame:
        return greedy_joins(some, tokens, chosen, id_col=id_col).groupBy("phrase").agg(F.count("*").alias("joins"), F.count_distinct(id_col).alias("docs"))

    if chosen.count() > MOST_PHRASES:
        return slowly(docs)
    table = chosen.toArrow()
    terms = pc.unique(pa.concat_arrays([c for name in ("a", "b") for c in table.column(name).chunks] or [pa.array([], pa.string())]))
    n = len(terms)
    ends = [pc.index_in(table.column(c), terms).to_numpy().astype(np.int64) for c in ("a", "b")]
    sent = docs.sparkSession.sparkContext.broadcast((terms, np.sort(ends[0] * n + ends[1])))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, wanted = sent.value
        joins, found = np.zeros((2, len(wanted)), np.int64)
        for lists in (batch.column(0).slice(k, DOCS) for batch in it for k in range(0, batch.num_rows, DOCS)):
            ids = pc.fill_null(pc.index_in(lists.flatten(), terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            key = ids[:-1] * n + ids[1:]
            at = np.minimum(np.searchsorted(wanted, key), max(len(wanted) - 1, 0))
            if not len(wanted) or not len(key):
                continue
            start = np.flatnonzero((row[:-1] == row[1:]) & (ids[:-1] >= 0) & (ids[1:] >= 0) & (wanted[at] == key))
            new = np.diff(start, prepend=-2) > 1  # runs of starts; the gap at a row's end parts those of two rows
            first = start[new][np.cumsum(new) - 1] if len(start) else start
            start = start[(start - first) % 2 == 0]
            joins += np.bincount(at[start], minlength=len(wanted))
            found += np.bincount(np.unique(row[start] * len(wanted) + at[start]) % len(wanted), minlength=len(wanted))
        some = np.flatnonzero(joins)
        for k in range(0, len(some), 100_000):
            part = some[k : k + 100_000]
            names = [terms.take(pa.array(x)) for x in (wanted[part] // n, wanted[part] % n)]
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(*names, "_"), pa.array(joins[part]), pa.array(found[part])], names=["phrase", "joins", "docs"])

    shared = materialize(docs.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").select(F.col(id_col).alias("__shared")), "shared-ids")
    own = docs
    if shared.limit(1).count():
        own = docs.join(shared, F.col(id_col).eqNullSafe(F.col("__shared")), "left_anti")
    counted = own.select(tokens).mapInArrow(run, "phrase string, joins bigint, docs bigint")
    if own is not docs:
        counted = counted.unionByName(slowly(docs.join(shared, F.col(id_col).eqNullSafe(F.col("__shared")), "left_semi")))
    return counted.groupBy("phrase").agg(F.sum("joins").alias("joins"), F.sum("docs").alias("docs"))


def ppmi(counts: DataFrame, *, smoothing: float = 0.75, shift: float = 1.0) -> DataFrame:
    """(target, context, ppmi) above 0: contexts are smoothed by a power, log(shift) is taken off."""
    rows = materialize(counts.groupBy("target").agg(F.sum("value").alias("r")), "target-sums")
    cols = materialize(counts.groupBy("context").agg(F.pow(F.sum("value"), F.lit(smoothing)).alias("c")), "context-sums")
    total = cols.agg(F.sum("c").alias("t"))
    joined = counts.join(small(rows, MOST_TERMS), "target").join(small(cols, MOST_TERMS), "context").crossJoin(F.broadcast(total))
    value = F.log(F.col("value") * F.col("t") / (F.col("r") * F.col("c"))) - F.log(F.lit(shift))
    return joined.select("target", "context", value.alias("ppmi")).where(F.col("ppmi") > 0)


def cosine(a, b):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def expansion(vectors: DataFrame, seeds: DataFrame, *, id_col: str, vector_col: str, k: int) -> DataFrame:
    """(seed, rank, id, similarity): the k nearest of every seed by cosine; the seeds, a few by definition,
    are broadcast, and each partition keeps k of each before the merge (a window group limit)."""
    s = F.broadcast(seeds.select(F.col(id_col).alias("seed"), F.col(vector_col).alias("__s")))
    scored = vectors.join(s, F.col(id_col) != F.col("seed")).select("seed", F.col(id_col).alias("id"), F.round(cosine(F.col(vector_col), F.col("__s")), 6).alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("similarity"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("seed", "rank", "id", "similarity")


def consolidated(near: DataFrame, *, least: float = 0.0) -> DataFrame:
    """(id, best, best_seed, seeds): each neighbour once, with its largest similarity and all its seeds."""
    return near.where(F.col("similarity") >= least).groupBy("id").agg(F.max("similarity").alias("best"), F.min_by("seed", F.struct(-F.col("similarity"), F.col("seed"))).alias("best_seed"), F.array_join(F.transform(F.sort_array(F.collect_list("seed")), lambda x: x.cast("string")), ";").alias("seeds"))


def set_overlap(left: DataFrame, right: DataFrame, col: str) -> DataFrame:
    """(both, only_left, only_right, jaccard) of two sets."""
    a, b = left.select(col).distinct().withColumn("l", F.lit(1)), right.select(col).distinct().withColumn("r", F.lit(1))
    both = F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull())
    return a.join(b, col, "full_outer").agg(both.alias("both"), F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"), (both / F.count("*")).alias("jaccard"))

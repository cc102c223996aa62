"""Word vectors trained with negative sampling: words from the mean of their context, or contexts from their word.

Chunks of the corpus are dealt to shards of about as many tokens each. In a round every shard starts from the same vectors and
trains on its own chunks alone; what it moved a word by is averaged over shards, weighted by how often each met the word, in
groups of 64 at a time; a round writes at most 256 sums, however many shards there are. The vectors are bounded by the
vocabulary's parameter and are all that is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators.vectors import vocabulary
from lumenfold.sources.storage import materialize

#: Tokens of a chunk (windows don't reach over its ends), that a shard holds at a time, and positions of a step.
CHUNK, HELD, STEP = 1000, 20_000, 512
#: A step's positions share their drawn words: so many times the wanted number, each at as small a part of the weight.
SHARED = 16
#: Words of a block of the vectors, shards that are summed at a time, and bytes that may be broadcast.
WORDS, FAN, MOST_BYTES = 512, 64, 256 << 20
#: Sums of moves that a round writes at most; with more shards a task sums those of several before it writes them.
SUMS = 256


@dataclass(frozen=True)
class Training:
    """dim values a vector; at most window words to either side, of which each position draws how many it takes; so many
    negatives, drawn by frequency to the exponent; words above the share ``sample`` are thinned; the rate falls linearly."""

    dim: int = 100
    window: int = 5
    negative: int = 5
    method: str = "cbow"
    rounds: int = 5
    rate: float = 0.05
    least_rate: float = 0.0005
    sample: float = 1e-3
    exponent: float = 0.75
    shard_tokens: int = 500_000
    seed: int = 13

    def __post_init__(self):
        if self.method not in ("cbow", "skipgram"):
            raise ValueError("method is cbow or skipgram")


def alias_table(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chance, other): place k of a uniform draw stays k with its chance and is other[k] else, so that draws follow the weights."""
    n = len(weights)
    chance, other = weights * n / weights.sum(), np.arange(n)
    low, high = list(np.flatnonzero(chance < 1)), list(np.flatnonzero(chance >= 1))
    while low and high:
        small, large = low.pop(), high[-1]
        other[small] = large
        chance[large] -= 1 - chance[small]
        if chance[large] < 1:
            low.append(high.pop())
    chance[low + high] = 1
    return chance, other


def _chunks(docs: DataFrame, tokens: str, id_col: str, words: DataFrame) -> DataFrame:
    """(key, n, ids): known words of every document in order, a chunk of 1,000 a row; other words leave no gap."""
    narrow = words.count() <= 1 << 15
    known = docs.sparkSession.sparkContext.broadcast(pa.array([r.term for r in words.orderBy("id").select("term").collect()], pa.string()))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keys, places, lists = [], [], []
            rows, ends = batch.column(1), np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy())
            found = pc.fill_null(pc.index_in(rows.flatten(), known.value), -1).to_numpy()
            for key, start, end in zip(batch.column(0).to_pylist(), [0, *ends], ends):
                ids = found[start:end]
                ids = ids[ids >= 0]
                for at in range(0, len(ids), CHUNK):
                    keys.append(key)
                    places.append(at // CHUNK)
                    lists.append(ids[at : at + CHUNK])
            if lists:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(places, pa.int32()), pa.array(lists, pa.list_(pa.int16() if narrow else pa.int32()))], ["key", "n", "ids"])

    typed = docs.select(F.col(id_col).cast("string").alias("key"), F.col(tokens).cast("array<string>").alias("t"))
    return materialize(typed.mapInArrow(run, f"key string, n int, ids array<{'smallint' if narrow else 'int'}>"), "chunks")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class _Shard:
    """One shard's copy of the vectors and what it did to them."""

    def __init__(self, t: Training, start: np.ndarray, keep: np.ndarray, chance: np.ndarray, other: np.ndarray, rate: float, rng: np.random.Generator):
        self.t, self.start, self.v, self.keep, self.chance, self.other, self.rate, self.rng = t, start, start.copy(), keep, chance, other, rate, rng
        self.met = np.zeros(start.shape[:2])
        self.held, self.size = [], 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= HELD:
            self.train()

    def train(self) -> None:
        if not self.size:
            return
        ids, chunk = np.concatenate(self.held), np.repeat(np.arange(len(self.held)), [len(h) for h in self.held])
        self.held, self.size = [], 0
        stay = self.rng.random(len(ids)) < self.keep[ids]
        ids, chunk, w = ids[stay], chunk[stay], self.t.window
        steps = np.concatenate([np.arange(-w, 0), np.arange(1, w + 1)])
        for at in range(0, len(ids), STEP):
            here = np.arange(at, min(at + STEP, len(ids)))
            near = here[:, None] + steps
            inside = (near >= 0) & (near < len(ids))
            near = np.clip(near, 0, len(ids) - 1)
            inside &= (chunk[near] == chunk[here][:, None]) & (np.abs(steps) <= self.rng.integers(1, w + 1, len(here))[:, None])
            if self.t.method == "cbow":
                some = inside.any(1)
                self._step(ids[near[some]], inside[some], ids[here[some]])
            else:
                row, col = np.nonzero(inside)
                for k in range(0, len(row), STEP):
                    r, c = row[k : k + STEP], col[k : k + STEP]
                    self._step(ids[here[r]][:, None], np.ones((len(r), 1), bool), ids[near[r, c]])

    def _step(self, given: np.ndarray, mask: np.ndarray, wanted: np.ndarray) -> None:
        """Moves the vectors of the given words and of the wanted ones together, and those of drawn ones apart."""
        if not len(wanted):
            return
        drawn = self.rng.integers(0, len(self.chance), SHARED * self.t.negative)
        drawn = np.where(self.rng.random(len(drawn)) < self.chance[drawn], drawn, self.other[drawn])
        share = (mask / mask.sum(1, keepdims=True)).astype(np.float32)
        mean = np.matmul(share[:, None, :], self.v[0][given])[:, 0]
        near, far = self.v[1][wanted], self.v[1][drawn]
        pull = (1 - _sigmoid((mean * near).sum(1))) * np.float32(self.rate)
        push = _sigmoid(mean @ far.T) * (drawn != wanted[:, None]) * np.float32(-self.rate / SHARED)
        back = pull[:, None] * near + push @ far
        self._move(1, np.concatenate([wanted, drawn]), np.concatenate([pull[:, None] * mean, push.T @ mean]))
        self._move(0, given[mask], np.repeat(back, mask.sum(1), 0))

    def _move(self, side: int, words: np.ndarray, by: np.ndarray) -> None:
        """Adds the rows of ``by`` word for word; the steps of a word that is met often are shortened to a length of 1."""
        order = np.argsort(words, kind="stable")
        words, first, times = np.unique(words[order], return_index=True, return_counts=True)
        total = np.add.reduceat(by[order], first, 0)
        self.v[side][words] += total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1)
        self.met[side][words] += times

    def moved(self) -> np.ndarray:
        """(2, words, 1 + dim): how often each word was met, and its move times that."""
        return np.concatenate([self.met[:, :, None], (self.v.astype(np.float64) - self.start) * self.met[:, :, None]], 2)


def _round(chunks: DataFrame, shards: int, t: Training, number: int, v: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The vectors after every shard trained on its chunks once."""
    sc = chunks.sparkSession.sparkContext
    rate = max(t.least_rate, t.rate * (1 - number / t.rounds))
    share = counts / counts.sum()
    keep = np.minimum(1, np.sqrt(t.sample / share) + t.sample / share) if t.sample else np.ones(len(counts))
    sent = sc.broadcast((v, keep, *alias_table(counts**t.exponent)))

    per = -(-shards // SUMS)

    def moves(model: _Shard, total: np.ndarray | None) -> np.ndarray:
        model.train()
        return model.moved() if total is None else total + model.moved()

    def blocks(group: int, moved: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, moved.shape[1], WORDS):
            if moved[:, at : at + WORDS, 0].any():
                yield pa.RecordBatch.from_arrays([pa.array([at // WORDS]), pa.array([group]), pa.array([moved[:, at : at + WORDS].tobytes()], pa.binary())], ["block", "shard", "moved"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, model, total = None, None, None
        for batch in it:
            for shard, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                if shard != at:
                    if model:
                        total = moves(model, total)
                        if shard // per != at // per:
                            yield from blocks(at // per, total)
                            total = None
                    at, model = shard, _Shard(t, *sent.value, rate, np.random.default_rng([t.seed, number, shard]))
                model.add(ids.values.to_numpy().astype(np.int32))
        if model:
            yield from blocks(at // per, moves(model, total))

    def summed(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["shard"].to_pylist(), table["moved"].to_pylist()))
        total = np.sum([np.frombuffer(b) for _, b in rows], 0)
        return pa.table({"block": table["block"][:1].cast(pa.int64()), "shard": pa.array([rows[0][0] // FAN]), "moved": pa.array([total.tobytes()], pa.binary())})

    groups = -(-shards // per)
    dealt = chunks.select("shard", "ids", "key", "n").repartitionById(groups, F.expr(f"shard div {per}").cast("int")).sortWithinPartitions("shard", "key", "n", "ids")
    parts, left, schema = materialize(dealt.select("shard", "ids").mapInArrow(run, "block long, shard long, moved binary"), "moved"), groups, "block long, shard long, moved binary"
    while True:
        parts, left = parts.groupBy("block", F.floor(F.col("shard") / FAN)).applyInArrow(summed, schema), -(-left // FAN)
        if left == 1:
            break
        parts = materialize(parts, "moved")
    out = v.copy()
    for r in parts.collect():  # the vectors, bounded by the vocabulary
        total = np.frombuffer(r.moved).reshape(2, -1, 1 + t.dim)
        at = slice(r.block * WORDS, r.block * WORDS + total.shape[1])
        out[:, at] += (total[:, :, 1:] / np.maximum(total[:, :, :1], 1)).astype(np.float32)
    sent.destroy()
    return out


def trained_vectors(docs: DataFrame, tokens: str, *, id_col: str, least: int, most: int = 20_000, training: Training = Training()) -> DataFrame:
    """(id, term, tf, vector): unit vectors (a word that was never met keeps its start) of the ``most`` frequent terms of at least
    ``least`` occurrences.

    Shards are as many as the corpus has ``shard_tokens`` of known words, so a task's work does not grow with the corpus. The same
    rows, ids and seed give the same vectors, however rows were partitioned. Ids are unique: chunks are dealt by them and sorted by
    them; rows that repeat both are trained each. Null token arrays and null tokens are none; no terms, or a vocabulary of vectors
    beyond 256 MB, is a ValueError. A chunk of 1,000 words bounds a window.
    """
    t = training
    if most * t.dim * 8 > MOST_BYTES:
        raise ValueError(f"{most} vectors of {t.dim} values are beyond {MOST_BYTES} bytes")
    words = vocabulary(docs, tokens, least=least, most=most)
    counts = np.array([r.tf for r in words.orderBy("id").select("tf").collect()], float)
    if not len(counts):
        raise ValueError(f"no term occurs {least} times")
    shards = max(1, -(-int(counts.sum()) // t.shard_tokens))
    chunks = _chunks(docs, tokens, id_col, words).withColumn("shard", F.pmod(F.xxhash64("key", "n", F.lit(t.seed)), F.lit(shards)))
    start = np.zeros((2, len(counts), t.dim), np.float32)
    start[0] = (np.random.default_rng(t.seed).random((len(counts), t.dim)) - 0.5) / t.dim
    for number in range(t.rounds):
        start = _round(chunks, shards, t, number, start, counts)
    v = start[0].astype(float)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    rows = docs.sparkSession.createDataFrame(pa.table({"id": pa.array(range(len(v)), pa.int64()), "vector": pa.array(list(v), pa.list_(pa.float64()))}))
    return words.join(F.broadcast(rows), "id").select("id", "term", "tf", "vector")


#: How a seed of several words becomes a vector.
MODES = ["phrase", "average", "phrase_fallback"]


def _unit(v: Column) -> Column:
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(length > 0, F.transform(v, lambda x: x / length)).otherwise(v)


def seed_vectors(vectors: DataFrame, seeds: DataFrame, *, mode: str) -> DataFrame:
    """(seed, vector, resolution) of distinct seeds (seed), words parted by spaces, from vectors (term, vector).

    One word is direct or seed_out_of_vocabulary. Several are the term joined by _ (phrase_token; else phrase_token_absent in
    mode phrase), or the unit mean of all their words (component_average, component_average_fallback in mode phrase_fallback;
    component_out_of_vocabulary if a word has none). Repeated terms of vectors are not allowed; null and blank seeds are left out.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    split = seeds.select(F.trim(F.regexp_replace("seed", r"\s+", " ")).alias("seed")).where("seed <> ''").distinct().select("seed", F.split("seed", " ").alias("w"))
    v = vectors.select(F.col("term").alias("__term"), F.transform(F.col("vector"), lambda x: x.cast("double")).alias("__v"))
    whole = split.join(v, F.array_join("w", "_") == F.col("__term"), "left").select("seed", "w", F.col("__v").alias("whole"))
    parts = split.where("size(w) > 1").select("seed", F.posexplode("w").alias("n", "word")).join(v, F.col("word") == F.col("__term"), "left")
    cells = parts.select("seed", F.posexplode_outer("__v").alias("d", "x")).groupBy("seed", "d").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    sums = cells.groupBy("seed").agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("d").isNotNull(), F.struct("d", "s")))), lambda c: c["s"]).alias("s"), F.min("n").alias("least"), F.max("n").alias("n"), F.count_if(F.col("d").isNull()).alias("none"))
    met = whole.join(sums, "seed", "left")
    one, found, all_there = F.size("w") == 1, F.col("whole").isNotNull(), F.col("none") == 0
    phrase, fallback = mode != "average", "component_average" if mode == "average" else "component_average_fallback"
    how = F.when(one, F.when(found, "direct").otherwise("seed_out_of_vocabulary")).when(F.lit(phrase) & found, "phrase_token")
    how = how.when(F.lit(mode == "phrase"), "phrase_token_absent").when(all_there, fallback).otherwise("component_out_of_vocabulary")
    mean = _unit(F.transform("s", lambda x: x / F.size("w")))
    return met.select("seed", F.when(how.isin("direct", "phrase_token"), F.col("whole")).when(how == fallback, mean).alias("vector"), how.alias("resolution"))


def seeded_terms(vectors: DataFrame, seeds: DataFrame, *, mode: str, k: int) -> DataFrame:
    """(term, max_cosine, nearest_seed, seed_rank, matches): the k nearest terms of every seed by cosine (six places), its own words
    left out, each term once with its best seed and how many seeds named it. Joined terms (with _) are dropped; seeds of one known word
    are pinned at 1.0 with rank 0, whatever they had. Ties go to the smaller term, then the smaller seed.

    Seeds are a list a person wrote and are broadcast; every task keeps k terms of each before they meet.
    """
    found = materialize(seed_vectors(vectors, seeds, mode=mode).where("vector is not null"), "seeds")
    unit = vectors.select("term", _unit(F.transform(F.col("vector"), lambda x: x.cast("double"))).alias("__v"))
    dot = F.aggregate(F.zip_with("__v", "__s", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    own = F.array_contains(F.split("seed", " "), F.col("term")) | (F.col("term") == F.replace("seed", F.lit(" "), F.lit("_")))
    scored = unit.join(F.broadcast(found.select("seed", _unit(F.col("vector")).alias("__s"))), ~own).select("seed", "term", F.round(dot, 6).alias("cosine"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("cosine"), "term"))).where(F.col("rank") <= k)
    near = ranked.where(~F.contains("term", F.lit("_"))).select("term", "cosine", "seed", "rank")
    pins = found.where(r"seed not like '% %' and not contains(seed, '_')").select(F.col("seed").alias("term"), F.lit(1.0).alias("cosine"), "seed", F.lit(0).alias("rank"))
    best = F.min_by(F.struct("cosine", "seed", "rank"), F.struct((F.col("rank") > 0).alias("a"), (-F.col("cosine")).alias("b"), F.col("seed").alias("c")))
    return near.unionByName(pins).groupBy("term").agg(best.alias("x"), F.count("*").alias("matches")).select("term", F.col("x.cosine").alias("max_cosine"), F.col("x.seed").alias("nearest_seed"), F.col("x.rank").alias("seed_rank"), "matches")

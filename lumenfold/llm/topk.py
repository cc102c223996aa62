"""Exact top-k inner products by columnar branch and bound.

Vectors lie by dimension: a tile of candidates is a matrix with one row a dimension. For a block of queries
the scores of all candidates grow by one block of dimensions at a time; by Cauchy and Schwarz the rest can
add at most the product of the norms that remain, so a candidate that cannot reach a query's k-th best is
dropped for that query, and the pairs that survive are compacted. Lower bounds of the k-th scores come from a
bounded set of candidates before the scan. Queries are broadcast in blocks of a fixed size; every task keeps
the best k of its candidates for each query, and these few are merged.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SCALE = 1024
K = 10
#: Queries broadcast at a time, and dimensions that scores grow by at a time.
QUERY_ROWS = 2048
DIMENSIONS = 8
TILE = 2048


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x array<bigint>) with each component floor(1024 * x); null vectors, and such with a null or
    non-finite component, are left out."""
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.where(F.col(vector_col).isNotNull() & ~bad).select(F.col(id_col).alias("id"), F.transform(vector_col, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("bigint")).alias("x"))


#: Scores are sums of doubles while no partial sum can leave the whole numbers that doubles hold; else of 64-bit integers.
EXACT = 2.0**52
#: Candidates that lower bounds of the k-th scores are taken from; they decide how much is pruned, never the result.
SEED_ROWS = 2048
#: Pairs that survive are followed singly once they are this share of a tile.
SPARSE = 0.5
#: Blocks of queries in one plan; their results are written before the next ones are planned.
WAVE = 16


def _tile(rows: list, width: int) -> np.ndarray:
    """Columns of one length as a matrix of whole numbers with one row a dimension."""
    return np.array(rows, np.int64).reshape(len(rows), width).T.copy()


def _tails(m: np.ndarray) -> np.ndarray:
    """Norms of what is left of each column from each block of dimensions on; the first are the whole norms."""
    squares = np.cumsum(np.square(m.astype(np.float64))[::-1], axis=0)[::-1]
    return np.sqrt(squares[::DIMENSIONS]) if len(m) else np.zeros((1, m.shape[1]))


class Best:
    """The k best (score, smaller id first) of every query so far, and a bound below the k-th."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.own, self.k, self.queries, self.tails = ids, k, queries, _tails(queries)
        self.score = [np.empty(0, np.int64) for _ in ids]
        self.id = [np.empty(0, np.int64) for _ in ids]
        self.floor = np.full(len(ids), -np.inf)
        #: Products of pairs and blocks of dimensions: all there were, and those computed.
        self.all = self.computed = 0

    def seed(self, ids: np.ndarray, m: np.ndarray) -> None:
        """Takes lower bounds from some candidates, which are none of the result yet."""
        if m.shape[1] > self.k and len(m) and not self._wide(_tails(m)):
            score = self.queries.T.astype(np.float64) @ m
            score[self.own[:, None] == ids] = -np.inf
            self.floor = np.partition(score, score.shape[1] - self.k, axis=1)[:, score.shape[1] - self.k]

    def _wide(self, tails: np.ndarray) -> bool:
        return bool(self.tails[0].max(initial=0) * tails[0].max(initial=0) >= EXACT)

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        keep = ids != self.own[q]
        score, own = np.concatenate([self.score[q], scores[keep]]), np.concatenate([self.id[q], ids[keep]])
        order = np.lexsort((own, -score))[: self.k]
        self.score[q], self.id[q] = score[order], own[order]
        if len(order) == self.k:
            self.floor[q] = max(self.floor[q], float(self.score[q][-1]))

    def scan(self, ids: np.ndarray, m: np.ndarray) -> None:
        """Branch and bound of one tile of candidates (one row a dimension) for all queries."""
        tails, n, steps = _tails(m), m.shape[1], range(0, len(m), DIMENSIONS)
        self.all += len(self.own) * n * len(steps)
        if self._wide(tails):  # rare: whole products in integers, nothing pruned
            self.computed += len(self.own) * n * len(steps)
            score = self.queries.T @ m
            for q in range(len(self.own)):
                self.add(q, ids, score[q])
            return
        m, queries = m.astype(np.float64), self.queries.astype(np.float64)
        score, at = np.zeros((len(self.own), n)), None
        for block, d in enumerate(steps):
            own = slice(d, d + DIMENSIONS)
            if at is None:
                score += queries[own].T @ m[own]
                self.computed += score.size
            else:
                q, c = at
                score = score + np.einsum("ij,ij->j", queries[own][:, q], m[own][:, c])
                self.computed += len(q)
            if block + 1 == len(steps):
                break
            # by Cauchy and Schwarz the rest adds no more than this; the margin is beyond any rounding
            if at is None:
                rest = np.outer(self.tails[block + 1], tails[block + 1]) * (1 + 1e-9) + 1e-3
                alive = score + rest >= self.floor[:, None]
                if np.count_nonzero(alive) < SPARSE * alive.size:
                    at = np.nonzero(alive)
                    score = score[at]
            else:
                keep = score + self.tails[block + 1][q] * tails[block + 1][c] * (1 + 1e-9) + 1e-3 >= self.floor[q]
                at, score = (q[keep], c[keep]), score[keep]
        if at is None:
            at = np.nonzero(score >= self.floor[:, None])
            score = score[at]
        else:
            keep = score >= self.floor[at[0]]
            at, score = (at[0][keep], at[1][keep]), score[keep]
        starts = np.searchsorted(at[0], np.arange(len(self.own) + 1))
        for q in np.flatnonzero(np.diff(starts)).tolist():
            hit = slice(starts[q], starts[q + 1])
            self.add(q, ids[at[1][hit]], score[hit].astype(np.int64))


def top_k(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with ``is_query`` the k largest inner products of whole
    numbers with the rows of other ids, ties to the smaller id; all, if there are fewer.

    Vectors are compared with those of their own length. Null vectors and such with a null or non-finite
    component take no part, nor do rows without an id. A repeated id is two candidates; as a query it is
    answered once, for its first vector in order. Empty vectors score 0. Scores that a bigint cannot hold wrap
    around. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    table = materialize(whole_numbers(vectors.where(F.col(id_col).isNotNull()), id_col, vector_col), "vectors")
    asked = whole_numbers(vectors.where(F.col(id_col).isNotNull() & is_query), id_col, vector_col)
    asked = asked.groupBy("id").agg(F.min("x").alias("x"))
    # queries in blocks of QUERY_ROWS at most: as many hash blocks as that takes on average at half the size
    blocks = max(1, -(-2 * asked.count() // QUERY_ROWS))
    asked = materialize(asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")), "queries")
    # any candidates serve as seeds, and no more than these come to the driver
    seeds = [(r.id, r.x) for r in table.limit(SEED_ROWS).collect()]
    parts, written = [], []
    for block in range(blocks):
        rows = asked.where(F.col("block") == block).limit(4 * QUERY_ROWS + 1).collect()
        if len(rows) > 4 * QUERY_ROWS:
            raise RuntimeError("a block of queries is too large")
        sent = {}
        for w in {len(r.x) for r in rows}:
            own, seed = [r for r in rows if len(r.x) == w], [x for x in seeds if len(x[1]) == w]
            sent[w] = np.array([r.id for r in own], np.int64), _tile([r.x for r in own], w), np.array([i for i, _ in seed], np.int64), _tile([x for _, x in seed], w)
        if rows:
            parts.append(table.select("id", "x").mapInArrow(_search(spark.sparkContext.broadcast(sent), k), "query_id bigint, vec_id bigint, score bigint"))
        if len(parts) == WAVE:
            written.append(materialize(_ranked(functools.reduce(DataFrame.unionByName, parts), k), "best"))
            parts = []
    if parts:
        written.append(_ranked(functools.reduce(DataFrame.unionByName, parts), k))
    if not written:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    return functools.reduce(DataFrame.unionByName, written)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _search(sent, k: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = {}
        for w, (ids, queries, seed_ids, seeds) in sent.value.items():
            asked[w] = Best(ids, queries, k)
            asked[w].seed(seed_ids, seeds)
        for batch in it:
            lists = batch.column(1)
            ids, width = batch.column(0).to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.concatenate([[0], np.cumsum(width)])
            for w in np.unique(width).tolist():
                if w not in asked:
                    continue
                which, best = np.flatnonzero(width == w), asked[w]
                for lo in range(0, len(which), TILE):
                    own = which[lo : lo + TILE]
                    m = flat[starts[own][:, None] + np.arange(w)].T.copy()
                    if w:
                        best.scan(ids[own], m)
                    else:
                        for q in range(len(best.own)):
                            best.add(q, ids[own], np.zeros(len(own), np.int64))
        for best in asked.values():
            n = [len(x) for x in best.id]
            if sum(n):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(best.own, n)), pa.array(np.concatenate(best.id)), pa.array(np.concatenate(best.score))], names=["query_id", "vec_id", "score"])

    return run


def op9_top_k(spark, sf_dir: str) -> DataFrame:
    """The ten largest inner products of every hundredth vector."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


OP9_SQL = """
WITH good AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
long AS (SELECT vec_id, generate_subscripts(x, 1) AS d, unnest(x) AS v FROM good),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, sum(q.v * c.v)::BIGINT AS score FROM long q JOIN long c ON q.d = c.d AND q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id GROUP BY ALL)
SELECT query_id, rank, vec_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM scored) WHERE rank <= 10"""

"""Queries over word vectors: trained ones of the documents, and a vocabulary grown from seeds over the given vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions import text as X
from lumenfold.operators import corpus as C
from lumenfold.operators import embedding as M
from lumenfold.plans.table_queries import table
from lumenfold.plans.text_queries import LEAST_TF
from lumenfold.sources.storage import materialize

NEAREST = 20


def word_vectors(spark, sf_dir):
    """The five nearest terms of each of the 100 most frequent terms, by vectors trained on all documents in two rounds."""
    training = M.Training(dim=50, rounds=2, sample=1e-4)
    docs = table(spark, sf_dir, "documents").select("doc_id", X.corpus_tokens(F.col("text")).alias("tokens"))
    vectors = materialize(M.trained_vectors(docs, "tokens", id_col="doc_id", least=LEAST_TF, training=training), "vectors")
    near = C.expansion(vectors, vectors.where("id < 100"), id_col="id", vector_col="vector", k=5)
    name = lambda c, new: F.broadcast(vectors.select(F.col("id").alias(c), F.col("term").alias(new)))  # noqa: E731  20,000 words at most
    return near.join(name("seed", "term"), "seed").join(name("id", "neighbour"), "id").select("term", "rank", "neighbour", "similarity")


def seeded_vocabulary(spark, sf_dir):
    """The 20 nearest vectors of each nation's seed: one word, two words, or two of which one is unknown."""
    v = table(spark, sf_dir, "embeddings").where("embedding is not null").select(F.concat(F.lit("w"), "vec_id").alias("term"), F.col("embedding").alias("vector"))
    k = F.col("n_nationkey")
    seed = F.when(k % 3 == 0, F.concat(F.lit("w"), k)).when(k % 3 == 1, F.concat(F.lit("w"), k, F.lit(" w"), k + 1)).otherwise(F.concat(F.lit("w"), k, F.lit(" unknown")))
    return M.seeded_terms(v, table(spark, sf_dir, "nation").select(seed.alias("seed")), mode="phrase_fallback", k=NEAREST)


SEEDED = f"""WITH v AS (SELECT vec_id, 'w' || vec_id AS term, embedding::DOUBLE[] AS vector FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT 'w' || n_nationkey AS seed, vector FROM nation JOIN v ON vec_id = n_nationkey WHERE n_nationkey % 3 = 0
    UNION ALL SELECT a.term || ' ' || b.term, list_transform(list_zip(a.vector, b.vector), lambda z: z[1] + z[2]) FROM nation JOIN v a ON a.vec_id = n_nationkey JOIN v b ON b.vec_id = n_nationkey + 1 WHERE n_nationkey % 3 = 1),
c AS (SELECT seed, term, round(list_cosine_similarity(v.vector, s.vector), 6) AS cosine FROM s JOIN v ON NOT list_contains(string_split(seed, ' '), term)),
r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY cosine DESC, term) AS rank FROM c QUALIFY rank <= {NEAREST}),
u AS (SELECT term, cosine, seed, rank FROM r UNION ALL SELECT seed, 1.0, seed, 0 FROM s WHERE NOT contains(seed, ' ')),
o AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY rank > 0, cosine DESC, seed) AS o, count(*) OVER (PARTITION BY term) AS matches FROM u)
SELECT term, cosine::DOUBLE AS max_cosine, seed AS nearest_seed, rank::INT AS seed_rank, matches FROM o WHERE o = 1"""

QUERIES = {"word_vectors": word_vectors, "seeded_vocabulary": seeded_vocabulary}
ORACLES = {"seeded_vocabulary": SEEDED}

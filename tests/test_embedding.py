import numpy as np
import pytest
from lumenfold.operators import embedding as M

GROUPS, EACH = 6, 4


def corpus(spark, n=1500, parts=3):
    """Sentences of one topic each; the words of a synonym group appear in the same contexts and never beside each other."""
    rng, rows = np.random.default_rng(1), []
    for k in range(n):
        g = int(rng.integers(GROUPS))
        topic = [f"ctx{g}c{c}" for c in rng.integers(0, 6, 8)]
        topic[4] = f"syn{g}s{int(rng.integers(EACH))}"
        rows.append((k, topic))
    return spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(parts)


def neighbours(v):
    terms, m = [r.term for r in v], np.array([r.vector for r in v])
    sims = m @ m.T
    np.fill_diagonal(sims, -2)
    return {t: terms[k] for t, k in zip(terms, sims.argmax(1))}


@pytest.mark.parametrize("method", ["cbow", "skipgram"])
def test_synonyms_are_nearest(spark, method):
    t = M.Training(dim=24, window=4, rounds=8, rate=0.1, method=method, sample=0, shard_tokens=4000)
    v = M.trained_vectors(corpus(spark), "tokens", id_col="doc_id", least=5, training=t).orderBy("id").collect()
    only = [r for r in v if r.term.startswith("syn")]
    assert len(only) == GROUPS * EACH and abs(np.linalg.norm(only[0].vector) - 1) < 1e-6
    assert np.mean([a[3] == b[3] for a, b in neighbours(only).items()]) >= 0.95


def test_same_rows_same_vectors_whatever_the_partitions(spark):
    t = M.Training(dim=8, rounds=2, shard_tokens=3000)
    a, b = ({r.term: r.vector for r in M.trained_vectors(corpus(spark, 300, p), "tokens", id_col="doc_id", least=2, training=t).collect()} for p in (1, 5))
    assert a == b and len(a) > 20


def test_alias_draws_follow_the_weights():
    w = np.array([1.0, 2, 3, 10, 0.5])
    chance, other = M.alias_table(w.copy())
    exact = np.array([sum((chance[k] if k == j else 0) + (1 - chance[k] if other[k] == j else 0) for k in range(5)) for j in range(5)]) / 5
    assert np.allclose(exact, w / w.sum())


def test_more_shards_than_are_summed_at_once(spark, monkeypatch):
    t = M.Training(dim=4, rounds=1, shard_tokens=200)
    docs = corpus(spark, 200)
    whole = {r.term: r.vector for r in M.trained_vectors(docs, "tokens", id_col="doc_id", least=2, training=t).collect()}
    monkeypatch.setattr(M, "FAN", 3)
    tree = {r.term: r.vector for r in M.trained_vectors(docs, "tokens", id_col="doc_id", least=2, training=t).collect()}
    assert whole.keys() == tree.keys() and all(np.allclose(whole[k], tree[k], atol=1e-5) for k in whole)


def test_odd_rows(spark):
    rows = [(1, None, 7), (2, [], 7), (3, ["a", None, "a", "b"], 7), (3, ["a"] * 2500 + ["b"], 7)]
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>, id int")
    got = M.trained_vectors(docs, "tokens", id_col="doc_id", least=2, training=M.Training(dim=4, rounds=1, sample=0)).collect()
    assert {(r.id, r.term, r.tf) for r in got} == {(0, "a", 2502), (1, "b", 2)} and all(np.isfinite(r.vector).all() for r in got)
    with pytest.raises(ValueError, match="no term"):
        M.trained_vectors(docs.limit(0), "tokens", id_col="doc_id", least=1)
    with pytest.raises(ValueError, match="beyond"):
        M.trained_vectors(docs, "tokens", id_col="doc_id", least=1, most=10_000_000)
    with pytest.raises(ValueError, match="method"):
        M.Training(method="glove")


VECTORS = [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("a_b", [0.6, 0.8]), ("c", [0.8, 0.6]), ("d", [0.0, -1.0]), ("z", [0.0, 0.0])]


def test_seed_vectors(spark):
    v = spark.createDataFrame(VECTORS, "term string, vector array<double>")
    seeds = spark.createDataFrame([("a",), ("a",), ("q",), ("a  b",), ("a c",), ("a q",), ("b d",), (None,), (" ",)], "seed string")
    rounded = lambda m: {r.seed: (r.resolution, r.vector and [round(x, 4) for x in r.vector]) for r in M.seed_vectors(v, seeds, mode=m).collect()}
    got = rounded("phrase_fallback")
    assert got == {"a": ("direct", [1.0, 0.0]), "q": ("seed_out_of_vocabulary", None), "a b": ("phrase_token", [0.6, 0.8]), "a c": ("component_average_fallback", [0.9487, 0.3162]), "a q": ("component_out_of_vocabulary", None), "b d": ("component_average_fallback", [0.0, 0.0])}
    assert rounded("average")["a b"] == ("component_average", [0.7071, 0.7071])
    assert rounded("phrase")["a c"] == ("phrase_token_absent", None)


def test_seeded_terms_pin_their_seeds(spark):
    v = spark.createDataFrame(VECTORS, "term string, vector array<double>")
    seeds = spark.createDataFrame([("a",), ("c",), ("a b",)], "seed string")
    got = {r.term: (r.max_cosine, r.nearest_seed, r.seed_rank, r.matches) for r in M.seeded_terms(v, seeds, mode="phrase_fallback", k=2).collect()}
    # a: c 0.8, a_b 0.6; c: a_b 0.96, a 0.8; a b (0.6, 0.8): c 0.96, z 0.0
    assert got == {"a": (1.0, "a", 0, 2), "c": (1.0, "c", 0, 3), "z": (0.0, "a b", 2, 1)}


def test_few_sums_are_written_however_many_shards(spark, monkeypatch):
    """A task sums the moves of several shards before they are written; the vectors stay what they were."""
    t, written, real = M.Training(dim=4, rounds=1, shard_tokens=200), [], M.materialize

    def kept(df, tag):
        out = real(df, tag)
        if tag == "moved":
            written.append(out.select("shard").distinct().count())
        return out

    monkeypatch.setattr(M, "materialize", kept)
    run = lambda: {r.term: r.vector for r in M.trained_vectors(corpus(spark, 300), "tokens", id_col="doc_id", least=2, training=t).collect()}
    whole = run()
    assert 8 < written[0] <= 256
    monkeypatch.setattr(M, "SUMS", 4, raising=False)
    written.clear()
    few = run()
    assert 1 <= written[0] <= 4 and whole.keys() == few.keys()
    assert all(np.allclose(whole[k], few[k], atol=1e-6) for k in whole)

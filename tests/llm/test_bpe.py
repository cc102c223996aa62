import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from lumenfold.llm import bpe
from lumenfold.llm.bpe import bpe_round_trip, codec, op2_byte_bpe

BLOB = open(P.path("byte_bpe_50k.tiktoken"), "rb").read()


@pytest.fixture(scope="module")
def reference():
    ranks, _ = codec(BLOB, P.PATTERN)
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks.ranks, special_tokens={})


def test_random_texts_equal_tiktoken(reference):
    _, split = codec(BLOB, P.PATTERN)
    rng = random.Random(5)
    letters = list("ab c\n\t  '’s ß漢字😀 re1²\x1c　-ABCTHE the\r")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(800)]
    for text, raw in zip(texts, split.ids(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == reference.encode_ordinary(text)


def test_long_words_by_either_tree(reference):
    ranks, _ = codec(BLOB, P.PATTERN)
    rng = random.Random(6)
    for word in (b"a" * 5000, b"the" * 500, bytes(rng.choice(b"abcdthe") for _ in range(1024)), "漢字".encode() * 200):
        wanted = reference._encode_single_piece(word)
        assert ranks.merge_one(word) == wanted
        assert np.frombuffer(ranks.merge([word])[0], "<u4").tolist() == wanted


def test_nulls_empties_repeats_and_other_columns(spark, reference):
    rows = [(1, "two words", 5, "x"), (1, "two words", 5, "x"), (2, None, 6, None), (None, "", None, "y"), (3, "z " * 30000, 7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, ids_sha256 string")
    got = bpe_round_trip(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert len(got) == len(rows)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    wanted = sorted((str(i), len(e := reference.encode_ordinary(t or "")), sha(" ".join(map(str, e)).encode()), sha((t or "").encode())) for i, t, _, _ in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == wanted
    assert bpe_round_trip(docs.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_whole_table_equals_tiktoken(spark, sf, reference):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op2_byte_bpe(spark, sf).collect():
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_rows_leave_by_groups_of_texts(spark, reference, monkeypatch):
    """A batch of many texts is encoded, and leaves, a few at a time; ids as arrays, in the rows' order."""
    import pyarrow as pa
    from lumenfold.llm import bpe

    rng = random.Random(8)
    texts = [None if k % 7 == 0 else " ".join(rng.choice(["alpha", "b9", "\n", "漢字"]) for _ in range(rng.randint(0, 40))) for k in range(60)]
    monkeypatch.setattr(bpe, "batches", lambda texts, real=bpe.batches: real(texts, 300))
    docs = spark.createDataFrame([(k, t, f"s{k}") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    taken = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: taken.append(run) or self)
    bpe_round_trip(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, keep=["source"], ids=True)
    whole = pa.RecordBatch.from_pydict({"doc_id": list(range(60)), "source": [f"s{k}" for k in range(60)], "__text": [t or "" for t in texts]})
    out = list(taken[0](iter([whole])))
    assert len(out) > 5 and max(b.num_rows for b in out) < 60
    rows = pa.Table.from_batches(out).to_pylist()
    assert [(r["doc_id"], r["source"], r["token_ids"], r["n_tokens"]) for r in rows] == [(k, f"s{k}", e := reference.encode_ordinary(t or ""), len(e)) for k, t in enumerate(texts)]


def test_each_different_chunk_of_a_group_is_looked_up_once():
    """Texts of many repeated words: lookups grow with the different chunks, not with the words."""

    class Counted(bpe.Cache):
        asked = 0

        def get(self, *key):
            Counted.asked += 1
            return super().get(*key)

    split = bpe.Splitter(P.PATTERN, lambda words: [len(w).to_bytes(4, "little") for w in words])
    split.later = Counted(bpe.CACHE)
    texts = ["a bb, ccc\n" * 500 + " x  y", "", "\u00a0 bb", "bb"]
    want = [b"".join(len(w).to_bytes(4, "little") for w in split.find(t)) for t in texts]
    assert split.ids(texts) == want and split.ids(texts) == want
    assert Counted.asked <= 2 * 3 * 12

import random

import public_tokenizers as P
import pytest
import tiktoken
from lumenfold.llm import recount as R

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as f:
        return R.counter(f.read(), P.PATTERN)


@pytest.fixture(scope="module")
def reference(own):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks.ranks, special_tokens={})


def edited(text, edits):
    for start, end, new in edits:
        start = min(max(start, 0), len(text))
        end = min(max(end, start), len(text))
        text = text[:start] + new + text[end:]
    return text


def test_random_edits_equal_a_new_count(own, reference):
    rng = random.Random(3)
    letters = list("ab c\n\t  ''rel ß漢 12 .,") + ["'re", " the", "   "]
    say = lambda n: "".join(rng.choice(letters) for _ in range(n))
    for _ in range(700):
        text = say(rng.randint(0, 120))
        edits = [(a := rng.randint(-3, 130), a + rng.randint(-2, 20), say(rng.randint(0, 9))) for _ in range(rng.randint(0, 6))]
        n, pieces, after, chars, _ = R.recount(own, [text], [edits])[0]
        new = edited(text, edits)
        assert (n, after, chars) == (len(reference.encode_ordinary(text)), len(reference.encode_ordinary(new)), len(new)), (text, edits)
        assert pieces == len(own.split(text))


def test_an_edit_encodes_its_surroundings_only(own):
    text = "some words of a long text, " * 4000
    assert R.recount(own, [text], [[(50_000, 50_010, "other words")]])[0][4] < 20


def test_nulls_repeats_and_long_texts(spark, reference):
    rows = [(1, "a few words", [(2, 5, "more")]), (1, "a few words", [(2, 5, "more")]), (2, None, [(0, 0, "new")]), (3, "x" * 50_000, [(7, 9, None), None]), (None, "no edits", None), (4, "", [(None, None, "q")])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, e array<struct<start: long, end: long, text: string>>, n_tokens int")
    got = sorted(((str(r.doc_id), r.n_tokens, r.n_tokens_after) for r in R.edited_counts(docs, docs.e, PATH, P.PATTERN).collect()))
    count = lambda t: len(reference.encode_ordinary(t))
    assert got == sorted((str(i), count(t or ""), count(edited(t or "", [(a or 0, b or 0, x or "") for a, b, x in filter(None, e or [])]))) for i, t, e in rows)
    assert R.edited_counts(docs.limit(0), docs.e, PATH, P.PATTERN).count() == 0


def test_whole_table_equals_a_new_count(spark, sf, reference):
    table = spark.read.parquet(f"{sf}/documents.parquet").withColumn("e", R.revision())
    want = {r.doc_id: (r.text, [tuple(x) for x in r.e]) for r in table.collect()}
    for r in R.op5_edited_counts(spark, sf).collect():
        text, edits = want[r.doc_id]
        new = edited(text, edits)
        assert (r.n_tokens, r.n_tokens_after, r.n_chars_after) == (len(reference.encode_ordinary(text)), len(reference.encode_ordinary(new)), len(new))

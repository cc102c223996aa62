"""Cross-tokenizer alignment against offsets of the whole text."""

import bisect
import functools
import hashlib

import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumenfold.llm import alignment as A

FILES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = ["", " ", "\n", "  a", "a  b", " lead", "trail ", "a \n b", "\n\nx", "a\tb", "x▁y", "▁", "café ﬁn \U0001f600\U0001f600 你好", "<|endoftext|> is text", "<s> a </s> <0x0A>", "don't we'll 123 4567", "a\r\nb", " b   c", "é ‍", "it's\n'll\n 's", "x" * 300, "é" * 90 + " z\n" + "ab " * 50, "a\x00b \x1c c", "1 2\n3", "...\n...  ...", "\x01a", "a \x01b", "\nx", "x\n", "word, Word. éa; x2, 's.", "a,\nb! c"]


@functools.cache
def tokenizers():
    a_tok, b_tok = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    a_tok.encode_special_tokens = True
    return a_tok, b_tok


def whole(texts):
    """Groups and links from byte offsets of the whole texts, all overlaps by interval arithmetic."""
    a_tok, b_tok = tokenizers()
    letters = {c: i for i, c in A.BYTE_LETTERS.items()}
    out = []
    for t in texts:
        want = (" " + t).encode() if t else b""
        a = a_tok.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_tok.encode(t) if t else []
        a_raw = [bytes(letters[c] for c in a_tok.id_to_token(i)) for i in a]
        b_raw = [bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not t or b"".join(a_raw) != want or b"".join(b_raw) != want:
            out.append(None)
            continue
        spans = []
        for raw in (a_raw, b_raw):
            at, ends = 0, []
            for x in raw:
                ends.append((at, at + len(x)))
                at += len(x)
            spans.append(ends)
        shared = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = [([], []) for _ in shared]
        for side, ids in enumerate((a, b)):
            for i, (_, e) in zip(ids, spans[side], strict=True):
                groups[bisect.bisect_left(shared, e)][side].append(i)
        starts = [s for s, _ in spans[1]]
        links = []
        for i, (s, e) in zip(a, spans[0], strict=True):
            k = bisect.bisect_right(starts, s) - 1
            while k < len(b) and spans[1][k][0] < e:
                links.append((i, b[k]))
                k += 1
        out.append((len(a), len(b), groups, links))
    return out


def said(groups):
    return ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)


def expected(texts):
    found = whole(texts)
    docs: dict = {}
    for x in found:
        for pair in set(x[3]) if x else ():
            docs[pair] = docs.get(pair, 0) + 1
    best: dict = {}
    for (a, _), n in docs.items():
        best[a] = max(best.get(a, 0), n)
    zero = (0, 0, 0, 0, 0, 0, "")
    return [zero if x is None else (x[0], x[1], len(x[2]), len(x[3]), sum(docs[p] == best[p[0]] for p in x[3]), sum(docs[p] for p in x[3]), hashlib.sha256(said(x[2]).encode()).hexdigest()) for x in found]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def files():
    with open(FILES[0], "rb") as a, open(FILES[1], "rb") as b:
        return a.read(), b.read()


def test_segments_spell_the_text_and_are_cut_where_both_end():
    for t in filter(None, ODD):
        assert "".join(map(A.spelled, A.segments(t))) == " " + t


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r'.,a1Z▁é 你"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_segments_align_as_the_whole_text(files, text):
    got, (want,) = A.aligner(*files).of([text])[0], whole([text])
    assert (got is None) == (want is None)
    if got:
        assert ";".join(x[3] for x in got) == said(want[2])
        assert sum(x[0] for x in got) == want[0] and sum(x[1] for x in got) == want[1]
        assert b"".join(x[4] for x in got) == b"".join((a << 32 | b).to_bytes(8, "little") for a, b in want[3])


def test_transducer_steps_are_memoised_and_groups_close_on_empty_residuals():
    t = A.Transducer([b"ab", b"c", b"abc"], [b"a", b"bc", b"abc"])
    groups, links = t.align([0, 1, 2], [0, 1, 2])
    assert groups == [([0, 1], [0, 1]), ([2], [2])] and [divmod(x, 1 << 32) for x in links] == [(0, 0), (0, 1), (1, 1), (2, 2)]
    states = len(t.states)
    assert t.align([0, 1, 0, 1], [0, 1, 0, 1])[0] == [([0, 1], [0, 1])] * 2 and len(t.states) == states
    with pytest.raises(ValueError):
        t.align([0, 1], [1])


def test_many_sequences_are_aligned_together_and_each_segment_is_looked_up_once(files):
    own = A.Aligner(*files)
    texts = [t for t in ODD if t] + ["the words, the words and the others.\nthe end" * 200]
    keys = sorted({k for t in texts[-1:] for k in A.segments(t)})
    a, b = ([list(ids) for ids in side] for side in (own._a_ids([A.spelled(k) for k in keys if k[0] != "\n"]), own.b.encode([k for k in keys if k[0] != "\n"])))
    at = [[sum(map(len, side[:k])) for k in range(len(side) + 1)] for side in (a, b)]
    got = own.transducer.align_all(*(A.np.array(x) for x in (sum(a, []), at[0], sum(b, []), at[1])))
    for x, y, groups, links, n in zip(a, b, *got, strict=True):
        want = own.transducer.align(x, y)
        assert groups == said(want[0]) and links == b"".join(k.to_bytes(8, "little") for k in want[1]) and n == len(want[0])

    class Counted(A.Cache):
        asked = 0

        def get(self, *key):
            Counted.asked += 1
            return super().get(*key)

    own.known = Counted(A.SEGMENTS)
    rows = A.rows_of(own, texts)
    for t, row, groups in zip(texts, rows[0], rows[1], strict=True):
        (want,) = whole([t])
        assert (row[:4], groups) == ((want[0], want[1], len(want[2]), len(want[3])), said(want[2])) if want else row == (0, 0, 0, 0, "")
    assert Counted.asked <= len(keys) + sum(map(len, ODD))


@pytest.mark.parametrize("hot_pairs", [A.HOT_PAIRS, 8])
def test_odd_rows_nulls_repeats_and_other_columns(spark, hot_pairs):
    texts = [*ODD, None, ODD[1], "a  b", "the the the", "the"]
    docs = spark.createDataFrame([(i % 20, t, "x", 1, 2) for i, t in enumerate(texts)], "doc_id int, text string, groups string, n_a int, __row int").repartition(4)
    rows = A.token_alignment(docs, *FILES, hot_pairs=hot_pairs).collect()
    want = expected([t or "" for t in texts])
    assert sorted((r.doc_id, *[r[c] for c in COLUMNS]) for r in rows) == sorted((i % 20, *w) for i, w in enumerate(want))
    assert A.token_alignment(docs.limit(0), *FILES).count() == 0


def test_whole_table_and_groups_as_strings(spark, sf):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: w for (i, _), w in zip(docs, expected([t for _, t in docs]), strict=True)}
    rows = A.op13_token_alignment(spark, sf).collect()
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in rows} == want and len(rows) == len(docs)
    groups = A.aligned(spark.read.parquet(f"{sf}/documents.parquet"), *FILES).select("groups", "groups_sha256").collect()
    assert all((hashlib.sha256(g.encode()).hexdigest() if g else "") == s for g, s in groups)

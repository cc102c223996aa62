"""Collocations against counts of every phrase in plain Python."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from lumenfold.llm import collocation as C
from lumenfold.llm.slots import SlotTable

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least, max_words, top, share=50):
    f, n, candidates = Counter(), Counter(), {}
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(SMALL)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            score, k = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            candidates[lang, p] = (a, f[lang, p[:k]], f[lang, p[k:]], score)
    inside = set()
    for (lang, p), (a, *_) in candidates.items():
        for m in range(2, len(p)):
            for s in range(len(p) - m + 1):
                q = p[s : s + m]
                if 100 * a >= share * f[lang, q]:
                    inside.add((lang, q))
    out = []
    for lang in n:
        own = sorted(((p, v) for (x, p), v in candidates.items() if x == lang and (x, p) not in inside), key=lambda x: (-x[1][3], -x[1][0], " ".join(x[0]).encode()))
        out += [(lang, i, " ".join(p), a, l, r, n[lang], s) for i, (p, (a, l, r, s)) in enumerate(own[:top], 1)]
    return sorted(out)


def test_slots_are_minimal_and_strange_keys_are_told():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 50_000).astype(np.uint64)
    keys = np.unique(keys)
    table = SlotTable(keys[:40_000])
    assert sorted(table.slots(keys[:40_000])) == list(range(40_000)) and (table.slots(keys[40_000:]) == -1).all()
    assert (SlotTable(keys[:0]).slots(keys[:3]) == -1).all() and SlotTable(keys[:1]).slots(keys[:2]).tolist() == [0, -1]


@pytest.mark.parametrize(("max_words", "most_parts", "flush"), [(3, C.PARTS, C.FLUSH), (3, 2, 40), (4, C.PARTS, 40), (2, 3, 40)])
def test_small_table_with_nulls_ties_repeats_and_very_long_texts(spark, monkeypatch, max_words, most_parts, flush):
    monkeypatch.setattr(C, "FLUSH", flush)
    docs = [("en", "New York city. new  york\tCity, new york"), ("en", "new york city"), ("en", None), (None, "a b a b. A B"), ("", "x y z x y z x y"), ("fr", ""), ("en", "É é É é a.b"), ("en", "to be or not to be! " * 400), ("en", "the the the the the")] * 2
    df = spark.createDataFrame([(t, x, 1, "p") for x, t in docs], "text string, lang string, rank int, phrase string").repartition(3)
    got = C.collocations(df, least=2, max_words=max_words, top=5, most_parts=most_parts)
    assert sorted(tuple(r) for r in got.collect()) == brute(docs, 2, max_words, 5)


def test_equal_hashes_of_different_phrases_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(C, "_hashes", lambda words, lang: np.array([len(w) for w in words], np.uint64))
    docs = [("en", "aa bb. cc dd. aa bb. cc dd. aa dd")]
    table = C.level_counts(spark.createDataFrame(docs, "lang string, text string"), 1, None, 1)
    assert sum(len(r.n) // 4 for r in table.collect()) == 4
    counted = C.block_sums(table, 2).collect()
    assert sorted((r.phrase, r.f) for r in counted) == [("aa", 3), ("bb", 2), ("cc", 2), ("dd", 3)]


def test_empty_table_and_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert C.collocations(docs.limit(0)).count() == 0
    got = sorted(tuple(r) for r in C.op12_phrase_collocations(spark, sf).collect())
    assert got == brute([(r.lang, r.text) for r in docs.select("lang", "text").collect()], 10, 3, 2000)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet'")
    columns = "lang, rank, phrase, a, l, r, n, score"
    assert got == sorted(con.sql(f"SELECT {columns} FROM ({C.OP12_SQL})").fetchall())

import math
import re
from collections import Counter

import duckdb
import pytest
from lumenfold.llm import quality as Q
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_force(text):
    t = text or ""
    w = WORD.findall(t)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    places = {p for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n_words = len(w)
    return n_words, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(places), n_words < 50 or 100 * len(places) > 50 * n_words


TEXTS = [None, "", " \n\t", "a b c a b c", "x " * 40000, "one\none\n\n \ntwo é漢 😀|<>\none", "a b c d e f g " * 3 + "z", "  nbsp is a letter", "w1 w2 " + " ".join(f"u{i}" for i in range(70))]


def test_features_equal_brute_force(spark, sf):
    rows = [(i, t, "en" if i % 2 else None, 5) for i, t in enumerate(TEXTS)] + [(None, "a b", "en", 1), (0, None, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = Q.quality_rules(docs, none).collect()
    key = lambda r: str(r)
    assert sorted(((r.doc_id, *tuple(r)[1:7]) for r in got), key=key) == sorted(((i, *brute_force(t)) for i, t, _, _ in rows), key=key)
    assert all(r.kept == (not r.base_failed) for r in got)
    assert Q.quality_rules(docs.limit(0), none).count() == 0
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in Q.op7_quality_rules(spark, sf).collect():
        assert tuple(r)[1:7] == brute_force(texts[r.doc_id])


def test_binomial_bound(spark):
    exact = lambda k, n, p: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    cases = [(0, 10), (3, 40), (12, 900), (900, 900)]
    df = spark.createDataFrame(cases, "k long, n long").select(Q.binomial_cdf(F.col("k"), F.col("n"), 0.0125).alias("p"))
    assert [r.p for r in df.collect()] == pytest.approx([exact(k, n, 0.0125) for k, n in cases])


def test_cutoffs_are_safe_and_equal_sql(spark):
    # good documents have few symbols, bad ones many; "de" has too few labels for any proof
    rows, labels = [], []
    for i in range(900):
        bad = i % 4 == 0
        lang = "de" if i < 40 else "en"
        text = " ".join(f"w{i}x{j}" for j in range(60)) + " " + "# " * (i % 90 if bad else i % 7)
        rows.append((i, text, lang))
        labels.append((i, 0 if bad else 1, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels += [(7_000_000, 1, 0), (3, None, 0)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in Q.quality_rules(docs, marks).collect()}
    good = [i for i, q, _ in labels[:900] if q == 1]
    assert sum(not got[i] for i in good) <= Q.ALPHA * len(good)
    assert sum(not got[i] for i in range(40, 900, 4)) > 150
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("labels", marks.toPandas().astype({"quality": "Int32"}))
    assert dict(con.sql(f"WITH {Q.verdict_sql()} SELECT doc_id, kept FROM verdict").fetchall()) == got
    kept = Q.keep_good(docs.withColumn("kept", F.lit("mine")), marks)
    assert kept.columns == ["doc_id", "text", "lang", "kept"]
    assert {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}

import random

import pytest
from lumenfold.functions import text as TX
from lumenfold.operators import corpus as C
from lumenfold.operators import proximity as P
from lumenfold.sources.storage import materialize
from pyspark.sql import functions as F


def docs(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return df.withColumn("tokens", TX.scorer_tokens(F.col("text")))


def pairs(spark, text, supply, risk, **more):
    d = docs(spark, text)
    return P.near_pairs(P.occurrences(d, "tokens", P.vocabulary(spark, supply)), P.occurrences(d, "tokens", P.vocabulary(spark, risk)), **more)


def test_window_is_closed(spark):
    for gap, n in ((9, 1), (10, 0)):
        assert pairs(spark, "supply chain " + "filler " * gap + "risk", {"supply chain": 0.8}, {"risk": 1.0}).count() == n


def test_every_occurrence_pairs_even_with_itself(spark):
    got = pairs(spark, "supply chain risk risk resolved", {"supply chain": 0.8, "risk": 0.5}, {"risk": 1.0})
    assert got.count() == 6
    assert got.where("s = s2 and e = e2").count() == 2
    assert pairs(spark, "supply chain risk risk", {"risk": 0.5}, {"risk": 1.0}, same_spans=False).count() == 2


def test_resolution_is_near_the_supply_span(spark):
    d = docs(spark, "shortage hits us " + "filler " * 6 + "risk " + "filler " * 8 + "solved", "shortage risk solved", None, "")
    v = lambda t: P.vocabulary(spark, {t: 1.0})
    got = {r.id: (r.n_pairs, r.n_resolved) for r in P.raw_scores(d, "tokens", v("shortage"), v("risk"), v("solved")).collect()}
    assert got == {0: (1, 0), 1: (1, 1), 2: (0, 0), 3: (0, 0)}


def test_scaling_divides_by_the_population_deviation(spark):
    df = spark.createDataFrame([(0.0, True), (1.0, True), (2.0, True), (50.0, False)], "x double, m boolean")
    got = [r.x_scaled for r in P.scaled(df, ["x"], F.col("m")).orderBy("x").collect()]
    assert got[:3] == pytest.approx([0, 1 / (2 / 3) ** 0.5, 2 / (2 / 3) ** 0.5]) and got[3] is None
    same = spark.createDataFrame([(4.0, True), (4.0, True)], "x double, m boolean")
    assert {r.x_scaled for r in P.scaled(same, ["x"], F.col("m")).collect()} == {0.0}


def test_nearest_distance_equals_brute_force(spark):
    rng = random.Random(7)
    span = lambda: (s := rng.randint(0, 60), s + rng.randint(0, 3))
    left = [(d, *span()) for d in range(60) for _ in range(rng.randint(0, 4))]
    right = [(d, *span()) for d in range(60) for _ in range(rng.randint(0, 4))]
    schema = "id long, s int, e int"
    got = {r.id: r.distance for r in P.nearest_distance(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).where("distance is not null").collect()}
    wanted = {}
    for d, s, e in left:
        for d2, s2, e2 in right:
            if d == d2:
                wanted[d] = min(wanted.get(d, 99), max(0, s2 - e, s - e2))
    assert got == wanted


def test_tokenizers_and_flags(spark):
    row = docs(spark, "The mid-cap firm’s U.S. co-op").select("tokens", TX.corpus_tokens(F.col("text")).alias("c")).first()
    assert row.tokens == ["the", "mid-cap", "firm’s", "u.s", "co-op"] and row.c == ["the", "midcap", "firm", "s", "u", "s", "coop"]
    d = docs(spark, "this transcript not available here", "copy " * 2000, "a few words", " ".join(f"w{i}" for i in range(4000)), " ")
    got = [r.s for r in d.orderBy("doc_id").select(TX.integrity_status(F.col("text"), F.col("tokens")).alias("s")).collect()]
    assert got == ["content_absent"] * 3 + ["ok", "no_transcript_text"]


def test_inflections(spark):
    terms = spark.createDataFrame([("inventories",), ("stocking",), ("supply shock",), ("boxes",), ("box",), ("supply",), ("glass",), ("day",), ("",)], "t string")
    got = {r.t: set(r.x) for r in terms.select("t", TX.inflections(F.col("t")).alias("x")).collect()}
    assert got == {"inventories": {"inventories", "inventory"}, "stocking": {"stocking", "stockings"}, "supply shock": {"supply shock", "supply shocks"}, "boxes": {"boxes", "box"}, "box": {"box", "boxs", "boxes"}, "supply": {"supply", "supplys", "supplies"}, "glass": {"glass", "glasss", "glasses"}, "day": {"day", "days"}, "": {""}}


def test_greedy_joins_equal_a_pass(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcd") for _ in range(40)) for _ in range(30)]
    joinable = {("a", "b"), ("b", "a"), ("c", "c"), ("b", "c")}
    phrases = spark.createDataFrame(sorted(joinable), "a string, b string")
    got = {(r.doc_id, r.position) for r in C.greedy_joins(docs(spark, *texts), "tokens", phrases).collect()}
    wanted = set()
    for d, t in enumerate(texts):
        w, i = t.split(), 0
        while i + 1 < len(w):
            if (w[i], w[i + 1]) in joinable:
                wanted.add((d, i))
                i += 1
            i += 1
    assert got == wanted


def test_long_terms_meet_at_every_offset(spark):
    """A pair is found whatever the length of its terms and wherever the buckets end."""
    term = " ".join(f"w{k}" for k in range(25))
    texts = [["x"] * k + term.split() + ["x"] * gap + ["risk"] for k in range(20) for gap in (9, 10)]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, tokens array<string>")
    left, right = P.occurrences(d, "tokens", P.vocabulary(spark, {term: 1.0})), P.occurrences(d, "tokens", P.vocabulary(spark, {"risk": 1.0}))
    want = list(range(0, 40, 2))
    assert sorted(r.id for r in P.near_pairs(left, right).collect()) == want
    assert sorted(r.id for r in P.near_any(left, right).collect()) == want
    assert sorted(r.id for r in P.near_any(right, left).collect()) == want


def test_live_call_is_no_replay(spark):
    from lumenfold.operators import matching as M

    rows = [
        ("2020-03-04", "The replay is available from noon through Wednesday, March 4, 2020.", "replay"),
        ("2020-03-04", "Management will host a results call on Mar. 4th, 2020 at 9 AM. A replay ends March 9.", "live"),
        ("2020-03-04", "An earnings call is scheduled for March 4.", "live_year_implied"),
        ("2020-03-04", "There will be a conference call on March 5, 2020.", "no_date"),
        ("2020-03-04", "After the conference call the summit will be on March 4, 2020.", "no_schedule"),
        ("2020-03-04", "The dividend is paid on March 4, 2020, then May 40, 2020.", "no_schedule"),
        ("2020-03-04", "A replay runs until March 4, 2020. We will hold the conference call, which is long, at the hall, with questions and answers for all who are there, and with slides on the wall behind the stage for the whole of the time that it takes, on March 4, 2020.", "live"),
        ("2020-03-04", None, "no_date"),
    ]
    d = spark.createDataFrame(rows, "day string, text string, want string")
    got = d.select("text", "want", M.live_call(F.to_date("day"), F.col("text")).alias("got")).collect()
    assert [(r.text, r.got) for r in got] == [(r.text, r.want) for r in got]


def test_quarter_patterns(spark):
    from lumenfold.operators import matching as M

    yes = ["third quarter of fiscal 2012", "3rd fiscal quarter ended in 2012", "2012 had a strong third quarter", "fiscal year 2012: Q 3 quarter", "Q3 2012"]
    no = ["third quarter of 2013", "third quarter. In 2012", "second quarter of 2012", "", None]
    d = spark.createDataFrame([(t,) for t in yes + no], "t string")
    got = [r.m for r in d.select(M.quarter_mention(F.col("t"), F.lit(2012), F.lit(3)).alias("m")).collect()]
    assert got == [True] * len(yes) + [False] * len(no)


def test_rough_stems(spark):
    text = "Testing ring bringing halted bed Policies ties classes sses boxes gas glass o'Neil's 9s"
    words = spark.createDataFrame([(text,), (None,)], "t string").select(TX.letter_words(F.col("t")).alias("w"))
    got = [r.s for r in words.select(F.transform("w", TX.rough_stem).alias("s")).collect()]
    assert got == [["test", "ring", "bring", "halt", "bed", "policy", "tie", "class", "sse", "boxe", "gas", "glass", "o", "neil", "s", "s"], []]


def test_segments_equal_their_sql(spark, tmp_path):
    """Letters beyond ASCII after a question word, white space at the end, dotted capitals and nulls in the order."""
    import duckdb
    from lumenfold.plans import text_queries as Q

    texts = ["Doñueez esa.", "What é?", "isé", "İs it", "canſ", "who_", "HOW", "a? \t\r\n", "a?\x0b", "a?\x85", "a? ", "a?\n\n", None, "", "Why", "why not", "x\nwhat", "doÍ"]
    rows = [(k, turn, role, text) for k, text in enumerate(texts) for turn, role in ((0, "user"), (1, "assistant"))]
    rows += [(100, turn, role, text) for turn in (None, 1, 2) for role in ("user", None) for text in ("is it a b", None, "so c")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = Q.segments(spark, str(tmp_path))
    wanted = con.sql(Q.ORACLES["segments"])
    assert got.columns == wanted.columns and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, wanted.fetchall()))


def test_joined_phrases_equal_rows_of_all_joins(spark, monkeypatch):
    """Counts in the row equal those over all positions: repeated and null ids, nulls, runs, rows of few tokens, flushes.
    Only ids are shuffled by document, no positions."""
    rng = random.Random(3)
    lists = [[rng.choice("abcde") for _ in range(rng.randint(0, 30))] for _ in range(60)] + [None, ["a"], ["a", None, "b", "a", "b"], ["a"] * 9]
    lists[1:20:2] = [["a"]] * 10  # rows that share an id: their places don't meet
    ids = [None if k % 20 == 3 else k // 2 if k < 20 else k for k in range(len(lists))]
    df = spark.createDataFrame(list(zip(ids, lists, strict=True)), "doc_id long, tokens array<string>").repartition(3)
    alone = df.where("doc_id > 20").where("doc_id % 20 <> 3")
    for docs in (alone, alone.limit(0)):
        for pairs, docs_held in ((C.PAIRS, C.DOCS), (3, 7)):
            monkeypatch.setattr(C, "PAIRS", pairs)
            monkeypatch.setattr(C, "DOCS", docs_held)
            plain = C.bigram_counts(docs, "tokens").where("n >= 8 and a is not null and b is not null")
            assert sorted(C.frequent_bigrams(docs, "tokens", least=8).collect()) == sorted(plain.collect())
    phrases = materialize(C.frequent_bigrams(df, "tokens", least=20), "some")
    for docs in (alone, df.where("doc_id is not null")):
        slow = C.greedy_joins(docs, "tokens", phrases).groupBy("phrase").agg(F.count("*").alias("joins"), F.count_distinct("doc_id").alias("docs"))
        wanted = sorted(slow.collect())
        assert sorted(C.joined_phrases(docs, "tokens", phrases).collect()) == wanted and len(wanted) > 3
    with monkeypatch.context() as m:
        m.setattr(C, "greedy_joins", None)
        assert C.joined_phrases(alone, "tokens", phrases).count() > 3
    for name in ("MOST_WORDS", "MOST_PHRASES"):
        monkeypatch.setattr(C, name, 1)
    assert sorted(C.joined_phrases(alone, "tokens", C.frequent_bigrams(df, "tokens", least=20)).collect()) == sorted(C.greedy_joins(alone, "tokens", phrases).groupBy("phrase").agg(F.count("*").alias("joins"), F.count_distinct("doc_id").alias("docs")).collect())

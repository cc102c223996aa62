import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from lumenfold.operators import call_dates as D
from lumenfold.operators import frames as FR
from lumenfold.operators.records import ContractError
from test_entry import normal


@pytest.mark.parametrize("name", ["missing_cells", "stacked_parties", "study_places", "zero_flips", "payload_classes", "announced_calls", "weighted_forms", "seeded_vocabulary"])
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in "nation customer supplier orders lineitem events documents embeddings conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = E.queries()[name](spark, sf)
    cols = sorted(got.columns)
    assert normal(got.select(cols).collect()) == normal(con.sql(f"SELECT {', '.join(cols)} FROM ({E.oracle_sql()[name]})").fetchall())


def test_columns_by_rule(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["sic_a", "b.c", "x_key", "y_key"])
    assert FR.columns_of(df, prefix="sic_", suffix=("_key",)).columns == ["sic_a", "x_key", "y_key"]
    assert FR.columns_of(df, prefix="sic_", drop=True).columns == ["b.c", "x_key", "y_key"]
    assert FR.columns_of(df, names=["y_key", "b.c"]).columns == ["y_key", "b.c"]
    for given, why in [({"names": ["gone"]}, "gone"), ({"prefix": "q"}, "no column")]:
        with pytest.raises(ContractError, match=why):
            FR.columns_of(df, **given)


def test_stacked(spark):
    a, b = spark.createDataFrame([(1, "x")], "k long, t string"), spark.createDataFrame([(True, 2)], "f boolean, k long")
    assert [tuple(r) for r in FR.stacked([a, b, a.limit(0)]).orderBy("k").collect()] == [(1, "x", None), (2, None, True)]
    assert FR.stacked([a, b], fields=["f", "k"]).columns == ["f", "k"]
    with pytest.raises(ContractError, match="k is bigint and int"):
        FR.stacked([a, spark.createDataFrame([(1,)], "k int")])
    with pytest.raises(ContractError, match="no table"):
        FR.stacked([a], fields=["q"])


def test_complete_cases(spark):
    rows = [(1, 1.0, "0000000001"), (2, float("nan"), " "), (3, float("inf"), "7"), (4, None, None)]
    df = spark.createDataFrame(rows, "id int, x double, `c.k` string")
    kept, out = FR.complete_cases(df, ["x", "c.k"], {"digits": F.col("`c.k`").rlike(r"^\d{10}$")})
    assert [tuple(r) for r in kept.collect()] == rows[:1] and kept.columns == df.columns
    assert {r.id: r.missing for r in out.collect()} == {2: ["x", "c.k", "digits"], 3: ["x", "digits"], 4: ["x", "c.k", "digits"]}


def test_split_at_study(spark):
    df = spark.createDataFrame([(1, " 2010q1 "), (2, "2020Q1"), (3, "2019Q4")], "id int, q string")
    kept, late = FR.split_at_study(df, "q", "2010Q1", "2019Q4")
    assert ({r.id for r in kept.collect()}, [r.id for r in late.collect()]) == ({1, 3}, [2])
    bad = df.unionAll(spark.createDataFrame([(4, "2009Q4"), (5, None), (6, "2010Q5")], df.schema))
    with pytest.raises(ContractError, match="1 rows: before; 2 rows: malformed"):
        FR.split_at_study(bad, "q", "2010Q1", "2019Q4")


def test_labels(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 0.0), (0.0, 0.0), (2.0, 3.0), (nan, 0.0), (None, 0.0)], "a double, b double")
    assert [r[0] for r in df.select(FR.zero_flip(F.col("a"), F.col("b"))).collect()] == ["zero_to_positive", "positive_to_zero", "zero_in_both", "positive_in_both", None, None]
    df = spark.createDataFrame([("True",), ("true",), ("1",), (None,)], "t string")
    assert [r[0] for r in df.select(FR.is_true(F.col("t"))).collect()] == [True, False, False, False]
    df = spark.createDataFrame([("6770", "x"), ("1000", "BLANK CHECKS inc"), ("1000", "steel"), (None, None)], "s string, d string")
    assert [r[0] for r in df.select(FR.operating_exclusion(F.col("s"), F.col("d"))).collect()] == ["non_operating_sic_6770", "non_operating_sic_description", "", ""]


def test_response_class(spark):
    rows = [(404, "{}", True), (None, "{}", True), (200, '{"Note": null}', True), (200, '{"Information": "x", "Error Message": "y"}', True), (200, '{"Error Message": "y"}', True), (200, '{"a": {"Note": 1}}', True), (200, "[1]", None), (200, None, False)]
    df = spark.createDataFrame(rows, "s int, p string, h boolean")
    assert [r[0] for r in df.select(FR.response_class(F.col("s"), F.col("p"), F.col("h"))).collect()] == ["http_error_404", "http_error_none", "rate_limited", "information", "api_error", "success", "no_transcript", "no_transcript"]


GOOD = {"exists": True, "parse_error": "", "verified": True, "provider_class": "ok", "provider_reason": "", "words": 900, "speakers": 3, "placeholder": None, "cut": None, "payload_symbol": "AB", "symbol": "ab", "payload_quarter": "", "quarter": "2010Q1", "ticker_conflict": False, "issuer_named": True}
CASES = [
    ({}, "valid", "structural"), ({"exists": None}, "technical_failure", "unreadable"), ({"parse_error": "bad", "words": 0}, "technical_failure", "unreadable or missing payload: bad"), ({"parse_error": "bad"}, "valid", "structural"),
    ({"verified": False, "words": 0}, "quarantine", "raw payload"), ({"provider_class": "transport_error", "words": 0, "provider_reason": "slow"}, "technical_failure", "slow"), ({"provider_class": "transport_error", "words": None}, "technical_failure", "transport_error"),
    ({"provider_class": "no_transcript", "words": 0}, "no_transcript", "provider returned"), ({"words": 0}, "technical_failure", "empty payload"), ({"placeholder": "access denied", "payload_symbol": "X"}, "invalid_content", "confirmed non-transcript marker: access denied"),
    ({"payload_symbol": "X"}, "identity_mismatch", "payload symbol X"), ({"payload_quarter": "2011Q1"}, "identity_mismatch", "payload quarter 2011Q1"), ({"cut": "[truncated]"}, "quarantine", "[truncated]"), ({"words": 149}, "quarantine", "content is too short"),
    ({"speakers": 1}, "quarantine", "content is too short"), ({"ticker_conflict": True, "issuer_named": False}, "quarantine", "ticker reuse"), ({"ticker_conflict": True}, "valid", "structural"), ({"issuer_named": None}, "valid", "request identity agrees"),
]


def test_payload_class(spark):
    kinds = {k: "boolean" if isinstance(v, bool) else "int" if isinstance(v, int) else "string" for k, v in GOOD.items()}
    df = spark.createDataFrame([(n, *(GOOD | change).values()) for n, (change, *_) in enumerate(CASES)], "n int, " + ", ".join(f"{k} {t}" for k, t in kinds.items()))
    got = df.select("n", FR.payload_class(**{k: F.col(k) for k in GOOD}).alias("v")).orderBy("n").collect()
    for r, (change, name, why) in zip(got, CASES):
        assert r.v.classification == name and r.v.reason.startswith(why), (change, r)
    marks = spark.createDataFrame([("The ACCESS Denied content unavailable",), ("x",), (None,)], "t string").select(FR.first_mark(F.col("t"), FR.NOT_TRANSCRIPTS)).collect()
    assert [r[0] for r in marks] == ["content unavailable", None, None]


def test_announced_dates(spark):
    far = "x " * 200
    texts = [
        "Results for the first quarter 2018. The company will host a conference call on May 3, 2018 at 8:00 a.m.",
        "The quarter ended March 31, 2018. Revenue increased.",
        "May 1, 2018. Results are out. The company will host a conference call on Sept. 3rd, 2018 at 8.",
        "On June 31, 2018 and on Feb 29, 2016 we will hold our webcast.",
        f"webcast {'y' * 100} June 2, 2018",
        f"webcast {'y' * 100} beginning June 2, 2018",
        f"{far}May 3, 2018 {far}we will hold our webcast",
        "Earnings Call: Dec 1 2019, then Jan. 2nd 2020; dismay 3, 2019; Mayo 4, 2019; May 4, 1999",
        "", None, "conference call",
        "webcast and conference call on May 3, 2018",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in D.call_dates(df, "text", id_col="id").orderBy("id", "place").collect():
        got.setdefault(r.id, []).append(r.day)
    day = datetime.date
    assert got == {0: [day(2018, 5, 3)], 2: [day(2018, 9, 3)], 3: [day(2016, 2, 29)], 5: [day(2018, 6, 2)], 7: [day(2019, 12, 1), day(2020, 1, 2)], 11: [day(2018, 5, 3)]}
    long = spark.createDataFrame([(1, "conference call on May 3, 2018. " * 20_000)], "id int, text string")
    assert D.call_dates(long, "text", id_col="id").count() > 1


def test_with_inflections(spark):
    rows = [("suppliers", 0.9), ("supplier", 0.5), ("supply  chain", 0.7), (" ", 1.0), (None, 1.0), ("x", None), ("y", float("nan"))]
    got = {r.term: (r.weight, r.source) for r in D.with_inflections(spark.createDataFrame(rows, "term string, weight double")).collect()}
    assert got == {"supplier": (0.9, "suppliers"), "suppliers": (0.9, "suppliers"), "supply chain": (0.7, "supply chain"), "supply chains": (0.7, "supply chain")}

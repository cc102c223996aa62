import io
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from lumenfold.operators.records import ContractError
from lumenfold.sources import filings as S
from test_entry import normal


@pytest.mark.parametrize("name", ["price_files", "factor_archives", "filing_headers", "company_documents", "file_layouts", "strict_dictionary", "index_census"])
def test_files_written_from_tables_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ["customer", "part", "orders", "lineitem"]:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = E.queries()[name](spark, sf)
    cols = sorted(got.columns)
    assert normal(got.select(cols).collect()) == normal(con.sql(f"SELECT {', '.join(cols)} FROM ({E.oracle_sql()[name]})").fetchall())


def test_prices_take_either_name_and_count_what_they_reject(spark, tmp_path):
    (tmp_path / "a.csv").write_text("symbol,Adj Close,date,ticker2\n x ,5.5,2010-01-04,q\n,1,2010-01-04,q\ny,2,,q\nX,7,20100105,q\n")
    assert {(r.ticker, str(r.date), r.close) for r in S.read_prices(spark, str(tmp_path / "a.csv")).collect()} == {("X", "2010-01-04", 5.5), ("X", "2010-01-05", 7.0)}
    (tmp_path / "b.csv").write_text("ticker,date,adjusted_close\nx,2010-01-04,5\nX,20100104,6\ny,2010-01-04,abc\ny,2010-01-05,-1\ny,2010-01-06,NaN\ny,1/6/2010,4\ny,2010-01-07,\n")
    with pytest.raises(ContractError, match="2 rows: bad_close; 1 rows: bad_date; 2 rows: close_not_positive; 2 rows: repeated"):
        S.read_prices(spark, str(tmp_path / "b.csv"))
    (tmp_path / "c.csv").write_text("name,date,close\n")
    with pytest.raises(ContractError, match=r"ticker \(ticker or symbol\), close"):
        S.read_prices(spark, str(tmp_path / "c.csv"))
    (tmp_path / "d.csv").write_text("ticker,date,adjusted_close\n,,\n")
    with pytest.raises(ContractError, match="no valid rows"):
        S.read_prices(spark, str(tmp_path / "d.csv"))


def _zip(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in members:
            z.writestr(name, text)


def test_factors_from_text_and_archive(spark, tmp_path):
    text = "\xa9 notes 2010\r\n\r\n20100104   1.50  -0.20 0.001\r\n2010-01-05, 1, 2, 3, 4\r\n20100106 1 -99.99 3\r\n20100107 1 2\r\n20101399 1 2 3\r\n"
    _zip(tmp_path / "f.zip", [("dir/", ""), ("dir/a.txt", text.encode("latin-1")), ("b.txt", "20200101 9 9 9\n")])
    (tmp_path / "f.txt").write_bytes(text.encode("latin-1"))
    for name in ["f.zip", "f.txt"]:
        got = {(str(r.date), r.a, r.b, r.c) for r in S.read_factors(spark, str(tmp_path / name), ["a", "b", "c"]).collect()}
        assert got == {("2010-01-04", 0.015, -0.002, 0.00001), ("2010-01-05", 0.01, 0.02, 0.03)}
    assert S.read_factors(spark, str(tmp_path / "f.txt"), ["a"], units="decimal").where("date = '2010-01-04'").first().a == 1.5
    (tmp_path / "twice.txt").write_text("20100104 1\n20100104 1\n")
    with pytest.raises(ContractError, match="2 rows: repeated"):
        S.read_factors(spark, str(tmp_path / "twice.txt"), ["a"])
    _zip(tmp_path / "none.zip", [("dir/", "")])
    (tmp_path / "broken.zip").write_bytes(b"PK\x03\x04 broken")
    for name in ["none.zip", "broken.zip"]:
        with pytest.raises(ContractError, match="1 rows: no_file"):
            S.read_factors(spark, str(tmp_path / name), ["a"])
    with pytest.raises(ValueError, match="units"):
        S.read_factors(spark, str(tmp_path / "f.txt"), ["a"], units="bps")


def test_lines_of_a_member_come_in_blocks(spark):
    out = io.BytesIO()
    _zip(out, [("a", "".join(f"{k}\n" for k in range(25)))])
    files = spark.createDataFrame([("p", bytearray(out.getvalue()), 1), ("q", None, 1), ("r", bytearray(b""), 1)], "path string, content binary, line int")
    got = S.archive_lines(files, rows=10).collect()
    assert [(r.line_no, r.line) for r in got if r.path == "p"] == [(k + 1, str(k)) for k in range(25)]
    assert [(r.member, r.line) for r in got if r.path == "q"] == [(None, None)] and not [r for r in got if r.path == "r"]


def test_headers(spark, tmp_path):
    head = "CENTRAL INDEX KEY:   77\nSTANDARD INDUSTRIAL CLASSIFICATION: X [1234]\nFILED AS OF DATE: 20100102\n"
    late = "x" * 50_000 + head
    rows = [("0000000077", "a", head + "</SEC-HEADER>"), ("0000000077", "a", "FILED AS OF DATE: 20110102"), ("0000000078", "b", head), ("0000000077", "c", late), ("0000000077", "d", "</SEC-HEADER>" + head), ("0000000077", "e", None), ("0000000077", "f", head.replace("0102", "1399"))]
    df = spark.createDataFrame(rows, "issuer string, h string, problem string")
    got = {r.h: (r.cik, r.sic, str(r.filing_date), r.problem) for r in S.filing_history(df, issuer="issuer", accession="h", text="problem").collect()}
    sound = ("0000000077", "1234", "2010-01-02")
    assert got == {"a": (*sound, None), "b": (*sound, "other_issuer"), "c": (None, None, "None", "no_cik"), "d": (None, None, "None", "no_cik"), "e": (None, None, "None", "no_cik"), "f": ("0000000077", "1234", "None", "no_date")}
    (tmp_path / "s.txt").write_text("one\ntwo</SEC-DOCUMENT>\n three</SEC-DOCUMENT>\n\n")
    assert {r.text.strip() for r in S.read_submissions(spark, str(tmp_path / "s.txt")).collect()} == {"one\ntwo", "three"}


def test_company_fields(spark):
    rows = ["<a:x xmlns:a='u'><a:cik z='1'>\n 7 </a:cik><cik>8</cik><conformed-name>A &amp;lt; B</conformed-name><fiscal-year-end /><cikx>9</cikx></a:x>", '  {"sic": 12, "sicDescription": null}', "", None, "<cik>", "<company-cik>3</company-cik>"]
    got = spark.createDataFrame([(r,) for r in rows], "cik string").select(S.company_fields(F.col("cik")).alias("f")).select("f.*").collect()
    assert (got[0].cik, got[0].conformed_name, got[0].fiscal_year_end, got[0].assigned_sic) == ("7", "A &lt; B", "", None)
    assert (got[1].assigned_sic, got[1].assigned_sic_desc, got[1].cik) == ("12", "", None)
    assert all(v is None for k in (2, 3, 5) for v in got[k]) and got[4].cik == ""


def test_strict_terms(spark, tmp_path):
    path = tmp_path / "t.txt"
    path.write_text("supply chain\nmid-cap\nrisk\n")
    assert {r.term for r in S.read_strict_terms(spark, str(path), 3).collect()} == {"supply chain", "mid-cap", "risk"}
    for text, why in [("a\nb\n", "2 terms, 3 were promised"), ("a\n\nb\n", "1 rows: blank"), ("A\nb\nc\n", "1 rows: malformed"), (" a\nb  c\nd\n", "2 rows: malformed"), ("a\na\nb\n", "2 rows: repeated"), ("", "no valid rows")]:
        path.write_text(text)
        with pytest.raises(ContractError, match=why):
            S.read_strict_terms(spark, str(path), 3)
    with pytest.raises(ContractError, match="there is no dictionary"):
        S.read_strict_terms(spark, str(tmp_path / "gone.txt"), 3)


def test_inventory(spark, tmp_path):
    for name in ["inner/AB_2011Q1.json", "inner/AB/2011Q2/try1.json", "other/notes.json", "other/x.txt"]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("{}")
    layouts = {"flat": (r"/([A-Z]+)_(201\dQ[1-4])\.json", ["symbol", "quarter"]), "nested": (r"/([A-Z]+)/(201\dQ[1-4])/[^/]+\.json", ["symbol", "quarter"])}
    top = f"file://{tmp_path}"
    got = {(r.path.rpartition("/")[2], r.root == f"{top}/inner", r.bytes, r.layout, r.symbol, r.quarter) for r in S.inventory(spark, [f"{top}/inner", f"{top}/gone", top], layouts, glob="*.json").collect()}
    assert got == {("AB_2011Q1.json", True, 2, "flat", "AB", "2011Q1"), ("try1.json", True, 2, "nested", "AB", "2011Q2"), ("notes.json", False, 2, None, None, None)}
    with pytest.raises(ContractError, match="none of the roots"):
        S.inventory(spark, [f"{top}/gone"], layouts)

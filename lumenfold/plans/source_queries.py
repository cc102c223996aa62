"""Queries over files that are written from the tables and read again by the readers of filings and prices."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from lumenfold.plans.table_queries import table
from lumenfold.sources import filings as S
from lumenfold.sources.readers import read_pipe_index
from lumenfold.sources.storage import materialize, shared_folder

WANTED = ["1-URGENT", "2-HIGH"]


def price_files(spark, sf_dir):
    """Prices of parts by shipping day in CSV files with other names of the columns, each row judged."""
    li = table(spark, sf_dir, "lineitem")
    price = F.when(F.col("l_linenumber") == 7, "n/a").when((F.col("l_linenumber") == 6) & (F.col("l_returnflag") == "R"), "-1.0").otherwise(F.col("l_extendedprice").cast("string"))
    ticker = F.when((F.col("l_linenumber") == 5) & (F.col("l_returnflag") == "N"), " ").otherwise(F.concat(F.lit(" p"), "l_partkey"))
    day = F.when((F.col("l_linenumber") == 4) & (F.col("l_linestatus") == "O"), F.lit("soon")).when(F.col("l_linestatus") == "F", F.date_format("l_shipdate", "yyyyMMdd")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    path = shared_folder(spark, "prices")
    li.select(ticker.alias("symbol"), day.alias("date"), price.alias("Adj Close"), "l_suppkey").write.option("header", True).csv(path)
    return S.judged_prices(spark.read.option("header", True).csv(path))


PRICES = """WITH r AS (SELECT CASE WHEN l_linenumber = 5 AND l_returnflag = 'N' THEN '' ELSE 'P' || l_partkey END AS ticker, CASE WHEN l_linenumber = 4 AND l_linestatus = 'O' THEN NULL ELSE l_shipdate::DATE END AS date,
    l_linenumber = 4 AND l_linestatus = 'O' AS soon, CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 AND l_returnflag = 'R' THEN -1.0 ELSE l_extendedprice END AS close FROM lineitem),
p AS (SELECT ticker, date, close, CASE WHEN ticker = '' THEN 'no_ticker' WHEN date IS NULL AND NOT soon THEN 'no_date' WHEN date IS NULL THEN 'bad_date' WHEN close IS NULL THEN 'bad_close' WHEN close <= 0 THEN 'close_not_positive' END AS problem FROM r),
g AS (SELECT ticker, date, problem, count(*) AS rows, min(close) AS close FROM p GROUP BY ALL)
SELECT ticker, date, CASE WHEN problem IS NULL AND rows = 1 THEN close END AS close, coalesce(problem, CASE WHEN rows > 1 THEN 'repeated' END) AS problem, rows FROM g"""


def _archives(spark, sf_dir):
    days = table(spark, sf_dir, "lineitem").where("l_shipdate is not null").groupBy(F.to_date("l_shipdate").alias("day")).agg((F.sum("l_quantity").cast("long") % 97 - 9).alias("a"), F.count("*").alias("n"))
    values = F.when(F.col("n") % 13 == 0, F.col("a").cast("string")).when(F.col("n") % 11 == 0, F.concat_ws("  ", F.col("a").cast("string"), F.lit("-99.99"))).otherwise(F.concat_ws("  ", F.col("a").cast("string"), (F.col("n") % 97 - 9).cast("string"), F.lit("0.5")))
    lines = days.select(F.date_format("day", "yyyyMM").alias("month"), F.concat(F.date_format("day", "yyyyMMdd"), F.lit("   "), values).alias("line"), F.when(F.col("n") % 17 == 0, 2).otherwise(1).alias("times"))

    def packed(month: pd.DataFrame) -> pd.DataFrame:
        """A month's lines, 31 at most, as the first file of an archive."""
        out, text = io.BytesIO(), "Daily factors in percent\n\n" + "".join(f"{line}\n" * times for line, times in zip(month["line"], month["times"])) + "\nCopyright\n"
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("folder/", "")
            archive.writestr("daily.txt", text)
            archive.writestr("notes.txt", "20000101 1 1 1\n")
        return pd.DataFrame({"path": [month["month"].iloc[0]], "content": [out.getvalue()]})

    return materialize(lines.groupBy("month").applyInPandas(packed, "path string, content binary"), "archives")


def factor_archives(spark, sf_dir):
    """Two factors of each shipping day, read from one ZIP a month, each line judged."""
    return S.judged_factors(S.archive_lines(_archives(spark, sf_dir)), ["first", "second"])


FACTORS = """WITH d AS (SELECT l_shipdate::DATE AS date, sum(l_quantity)::BIGINT % 97 - 9 AS a, count(*) AS n FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1),
p AS (SELECT strftime(date, '%Y%m') AS path, date, a, n % 97 - 9 AS b, CASE WHEN n % 17 = 0 THEN 2 ELSE 1 END::BIGINT AS rows, CASE WHEN n % 13 = 0 THEN 'short' WHEN n % 11 = 0 THEN 'missing' WHEN n % 17 = 0 THEN 'repeated' END AS problem FROM d)
SELECT path, date, CASE WHEN problem IS NULL THEN a / 100.0::DOUBLE END AS first, CASE WHEN problem IS NULL THEN b / 100.0::DOUBLE END AS second, problem, rows FROM p"""


def filing_headers(spark, sf_dir):
    """Orders as submissions in files of many, and what their headers say of the issuer under which each is filed."""
    o = table(spark, sf_dir, "orders")
    named = F.when(F.col("o_orderstatus") == "P", F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
    sic = F.when(F.col("o_orderpriority") == "5-LOW", F.lit("")).otherwise(F.concat(F.lit(" ["), (F.pmod("o_custkey", F.lit(900)) + 1000).cast("string"), F.lit("]")))
    filed = F.coalesce(F.concat(F.lit("FILED AS OF DATE:\t"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("\n")), F.lit(""))
    text = F.concat(
        F.lit("<SEC-DOCUMENT>"), F.lpad(F.col("o_custkey").cast("string"), 10, "0"), F.lit("/"), "o_orderkey", F.lit("\n<SEC-HEADER>\n"), filed, F.lit("CENTRAL INDEX KEY:\t\t"), named,
        F.lit("\nSTANDARD INDUSTRIAL CLASSIFICATION:  TRADE"), sic, F.lit("\n</SEC-HEADER>\nSTANDARD INDUSTRIAL CLASSIFICATION: [9999]\nFILED AS OF DATE: 19000101\n"),
    )
    path = shared_folder(spark, "submissions")
    o.select(text).write.option("lineSep", "</SEC-DOCUMENT>\n").text(path)
    read = S.read_submissions(spark, path)
    place = lambda k: F.regexp_extract("text", r"<SEC-DOCUMENT>(\d+)/(\S+)", k)
    return S.filing_history(read.select(place(1).alias("issuer"), place(2).alias("accession"), "text"), issuer="issuer", accession="accession", text="text")


HEADERS = """SELECT lpad(o_custkey::VARCHAR, 10, '0') AS issuer, o_orderkey::VARCHAR AS accession, lpad((o_custkey + CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)::VARCHAR, 10, '0') AS cik, CASE WHEN o_orderpriority <> '5-LOW' THEN (1000 + o_custkey % 900)::VARCHAR END AS sic, o_orderdate::DATE AS filing_date,
CASE WHEN o_orderpriority = '5-LOW' THEN 'no_sic' WHEN o_orderdate IS NULL THEN 'no_date' WHEN o_orderstatus = 'P' THEN 'other_issuer' END AS problem FROM orders"""


def company_documents(spark, sf_dir):
    """Customers as company metadata, XML or JSON, written to files and read to fields."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    xml = F.concat(
        F.lit('<?xml version="1.0"?><c:company xmlns:c="urn:c"><!-- <assigned-sic>1</assigned-sic> --><c:assigned-sic code="x"> '), F.col("c_nationkey") + 1000, F.lit(" </c:assigned-sic><assigned-sic>2</assigned-sic><cik>"), "c_custkey",
        F.lit("</cik><conformed-name>"), "c_name", F.lit(" &amp; Sons</conformed-name><fiscal-year-end/><assigned-sic-desc><![CDATA["), "c_mktsegment", F.lit("]]></assigned-sic-desc></c:company>"),
    )
    path = shared_folder(spark, "companies")
    c.select("c_custkey", F.when(F.col("c_mktsegment") == "MACHINERY", F.to_json(F.struct(F.col("c_nationkey").alias("sic"), F.col("c_mktsegment").alias("sicDescription")))).otherwise(xml).alias("payload")).write.json(path)
    return spark.read.schema("c_custkey long, payload string").json(path).select("c_custkey", S.company_fields(F.col("payload")).alias("f")).select("c_custkey", "f.*")


COMPANIES = """SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN c_nationkey ELSE c_nationkey + 1000 END::VARCHAR AS assigned_sic, c_mktsegment AS assigned_sic_desc, CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_custkey::VARCHAR END AS cik,
CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_name || ' & Sons' END AS conformed_name, CASE WHEN c_mktsegment <> 'MACHINERY' THEN '' END AS fiscal_year_end, NULL::VARCHAR AS state_location FROM customer"""


def file_layouts(spark, sf_dir):
    """Which status and quarter the files of orders hold by their paths alone, one root inside the other."""
    path = shared_folder(spark, "orders")
    o = table(spark, sf_dir, "orders").where("o_orderdate is not null and o_orderstatus is not null")
    o.select("o_orderkey", F.col("o_orderstatus").alias("symbol"), F.concat(F.year("o_orderdate"), F.lit("Q"), F.quarter("o_orderdate")).alias("quarter")).write.partitionBy("symbol", "quarter").json(path)
    found = S.inventory(spark, [f"{path}/symbol=F", f"{path}/gone", path], {"partitioned": (r"/symbol=([A-Z]+)/quarter=(\d{4}Q[1-4])/[^/]+\.json", ["symbol", "quarter"])}, glob="*.json")
    return found.groupBy("layout", "symbol", "quarter").agg((F.max("root") != path).alias("inner_root"), (F.sum("bytes") > 0).alias("filled"))


LAYOUTS = "SELECT DISTINCT 'partitioned' AS layout, o_orderstatus AS symbol, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter, o_orderstatus = 'F' AS inner_root, true AS filled FROM orders WHERE o_orderdate IS NOT NULL AND o_orderstatus IS NOT NULL"


def strict_dictionary(spark, sf_dir):
    """Names of parts in four spellings as lines of a strict dictionary: which of them it takes."""
    line = F.when(F.col("p_size") > 40, F.concat_ws(" ", "p_brand", "p_name")).when(F.col("p_size") == 1, F.concat(F.lit(" "), "p_name")).when(F.col("p_size") < 5, F.col("p_name")).otherwise(F.concat_ws(" ", "p_name", "p_partkey"))
    return S.judged_terms(table(spark, sf_dir, "part").select(line.alias("line")), "line")


STRICT = """WITH l AS (SELECT CASE WHEN p_size > 40 THEN p_brand || ' ' || p_name WHEN p_size = 1 THEN ' ' || p_name WHEN p_size < 5 THEN p_name ELSE p_name || ' ' || p_partkey END AS term FROM part)
SELECT term, CASE WHEN trim(term) = '' THEN 'blank' WHEN term LIKE '%#%' OR term LIKE ' %' THEN 'malformed' WHEN count(*) > 1 THEN 'repeated' END AS problem, count(*) AS rows FROM l GROUP BY term"""


def index_census(spark, sf_dir):
    """Orders as lines of a filing index between notes, counted by form."""
    path = shared_folder(spark, "index")
    lines = F.concat_ws("|", "o_custkey", F.lit("Name, Inc."), "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd"), F.concat(F.lit("data/"), "o_orderkey"))
    table(spark, sf_dir, "orders").select(F.concat(F.when(F.col("o_orderstatus") == "P", "Description: all forms\n").otherwise(""), lines)).write.text(path)
    return S.form_census(read_pipe_index(spark, path, ["cik", "name", "form", "date", "file"]), WANTED)


CENSUS = "SELECT o_orderpriority AS form, count(*) AS n, o_orderpriority IN ('1-URGENT', '2-HIGH') AS wanted FROM orders GROUP BY 1"

QUERIES = {"price_files": price_files, "factor_archives": factor_archives, "filing_headers": filing_headers, "company_documents": company_documents, "file_layouts": file_layouts, "strict_dictionary": strict_dictionary, "index_census": index_census}
ORACLES = {"price_files": PRICES, "factor_archives": FACTORS, "filing_headers": HEADERS, "company_documents": COMPANIES, "file_layouts": LAYOUTS, "strict_dictionary": STRICT, "index_census": CENSUS}

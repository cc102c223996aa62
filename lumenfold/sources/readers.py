"""Readers and writers of the engine's file kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_delimited(spark: SparkSession, path: str, columns: list[str], *, sep: str = ",") -> DataFrame:
    """A CSV or TSV with a header; cells of any length are strings, empty ones are null, codes keep zeroes."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').option("maxCharsPerColumn", -1).option("nullValue", "").option("enforceSchema", False).csv(path)


def read_pipe_index(spark: SparkSession, path: str, names: list[str], *, forms: list[str] | None = None, form_col: str = "form") -> DataFrame:
    """Lines of exactly as many fields as names, parted by '|'; other lines are notes. Optionally some forms only."""
    parts = spark.read.text(path).select(F.split("value", r"\|", -1).alias("p")).where(F.size("p") == len(names))
    rows = parts.select(*[F.trim(F.col("p")[k]).alias(n) for k, n in enumerate(names)]).where(F.col(names[0]) != names[0])
    return rows.where(F.col(form_col).isin(forms)) if forms else rows


def read_factor_text(spark: SparkSession, path: str, names: list[str], *, sentinel: float = 90.0) -> DataFrame:
    """Date-first lines of percentages (YYYYMMDD a b c): notes are skipped, values become fractions, sentinels null."""
    parts = spark.read.text(path).select(F.split(F.trim(F.regexp_replace("value", r"[,\s]+", " ")), " ").alias("p")).where(F.col("p")[0].rlike(r"^\d{8}$") & (F.size("p") == len(names) + 1))
    number = lambda k: F.when(F.abs(F.col("p")[k].cast("double")) < sentinel, F.col("p")[k].cast("double") / 100)
    return parts.select(F.to_date(F.col("p")[0], "yyyyMMdd").alias("date"), *[number(k + 1).alias(n) for k, n in enumerate(names)])


def read_price_map(spark: SparkSession, path: str, *, first: str, last: str) -> DataFrame:
    """JSON lines {ticker, prices: {date: close}} to (ticker, date, close); only finite closes above 0 in the period."""
    rows = spark.read.schema("ticker string, prices map<string, double>").json(path).select("ticker", F.explode("prices").alias("d", "close"))
    return rows.select("ticker", F.try_to_date("d", "yyyy-MM-dd").alias("date"), "close").where((F.col("close") > 0) & (F.col("close") < float("inf")) & F.col("date").between(first, last))


def read_weighted_terms(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of (term, max_cosine): the largest finite weight of each normalised term."""
    rows = spark.read.schema("term string, max_cosine double").json(path)
    good = rows.where(F.col("max_cosine").isNotNull() & ~F.isnan("max_cosine") & (F.abs("max_cosine") < float("inf")))
    return good.groupBy(F.trim(F.lower(F.regexp_replace("term", r"\s+", " "))).alias("term")).agg(F.max("max_cosine").alias("weight")).where("term <> ''").withColumn("words", F.split("term", " "))


def read_term_list(spark: SparkSession, path: str) -> DataFrame:
    """One term a line, '#' begins a comment; normalised and distinct."""
    rows = spark.read.text(path).select(F.trim(F.lower(F.regexp_replace(F.regexp_replace("value", "#.*$", ""), r"\s+", " "))).alias("term"))
    return rows.where("term <> ''").distinct()


def read_columnar_json(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """Documents of parallel arrays to rows."""
    schema = ", ".join(f"`{n}` array<{t}>" for n, t in fields.items())
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline(F.arrays_zip(*fields)))


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """Provider envelopes to segments (symbol, quarter, segment_number, speaker, title, content)."""
    turn = "array<struct<speaker: string, title: string, content: string>>"
    rows = spark.read.schema(f"payload struct<symbol: string, quarter: string, transcript: {turn}>, transcript {turn}").option("multiLine", True).json(path)
    turns = rows.select("payload.symbol", "payload.quarter", F.posexplode_outer(F.coalesce("payload.transcript", "transcript")).alias("n", "x"))
    return turns.select("symbol", "quarter", (F.col("n") + 1).alias("segment_number"), "x.speaker", "x.title", "x.content")


def read_documents(spark: SparkSession, path: str, kinds: list[str]) -> DataFrame:
    """SGML submissions (one file each) to (path, kind, body) of the first document of a wanted kind."""
    text = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.decode("content", "UTF-8").alias("t"))
    blocks = text.select("path", F.posexplode(F.regexp_extract_all("t", F.lit(r"(?s)<DOCUMENT>(.*?)</DOCUMENT>"), F.lit(1))).alias("n", "b"))
    typed = blocks.select("path", "n", F.trim(F.regexp_extract("b", r"<TYPE>([^\r\n<]*)", 1)).alias("kind"), F.regexp_extract("b", r"(?s)<TEXT>(.*?)(?:</TEXT>|$)", 1).alias("body")).where(F.col("kind").isin(kinds))
    return typed.groupBy("path").agg(F.min_by(F.struct("kind", "body"), "n").alias("x")).select("path", "x.*")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of tokens, gzip or plain, to (tokens array<string>)."""
    return spark.read.text(path).select(F.split("value", " ").alias("tokens"))


def write_once(df: DataFrame, path: str, *, kind: str = "parquet") -> None:
    """Refuses to overwrite."""
    df.write.mode("errorifexists").format(kind).save(path)


def write_csv(df: DataFrame, path: str, *, compressed: bool = False) -> None:
    df.write.mode("errorifexists").option("header", True).option("escape", '"').option("compression", "gzip" if compressed else "none").csv(path)


def append_ledger(df: DataFrame, path: str) -> None:
    """Adds rows; the state of a key is its latest row (operators.records.best_per_key)."""
    df.write.mode("append").json(path)

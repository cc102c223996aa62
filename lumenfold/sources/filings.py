"""Sources with a layout of their own: prices under aliases, factor archives, headers and metadata of filings, strict
term lists, inventories of files. Each judges every row and counts what it rejects; a strict reader raises instead."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.text import scorer_tokens
from lumenfold.functions.values import any_date, finite, padded
from lumenfold.operators.records import ContractError
from lumenfold.sources.storage import materialize

#: The names of price columns, the first of each that a file has.
PRICE_NAMES = {"ticker": ["ticker", "symbol"], "date": ["date"], "close": ["adjusted_close", "Adj Close"]}
#: Fields of a filing's header, its end, and how many characters of a file may hold it.
HEADER = {"cik": r"CENTRAL INDEX KEY:\s*(\d+)", "sic": r"STANDARD INDUSTRIAL CLASSIFICATION:[^\n]*\[(\d{4})\]", "filed": r"FILED AS OF DATE:\s*(\d{8})"}
HEADER_END, HEADER_CHARS = "</SEC-HEADER>", 50_000
#: Elements of company metadata, and where the JSON form has two of them.
COMPANY_TAGS = ["assigned-sic", "assigned-sic-desc", "cik", "conformed-name", "fiscal-year-end", "state-location"]
COMPANY_JSON = {"assigned-sic": "$.sic", "assigned-sic-desc": "$.sicDescription"}
#: Percentages of this size or more stand for a missing value.
SENTINEL = 90.0


def _text(name: str) -> Column:
    return F.trim(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")))


def _required(judged: DataFrame, ignored: Sequence[str] = ()) -> DataFrame:
    """Rows without a problem; a ContractError counts the problems that aren't ignored, or says that no row is left."""
    judged = materialize(judged, "judged")
    counts = {r.problem: r.n for r in judged.groupBy("problem").agg(F.sum("rows").alias("n")).collect()}  # a row a problem
    if wrong := sorted((p, n) for p, n in counts.items() if p is not None and p not in ignored):
        raise ContractError("; ".join(f"{n} rows: {p}" for p, n in wrong))
    if not counts.get(None):
        raise ContractError("no valid rows")
    return judged.where("problem is null").drop("problem", "rows")


def resolved(columns: Sequence[str], aliases: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """The first alias of each name that the columns hold; a ContractError names those without one."""
    found = {name: next((a for a in names if a in columns), None) for name, names in aliases.items()}
    if absent := [f"{name} ({' or '.join(aliases[name])})" for name, column in found.items() if column is None]:
        raise ContractError(f"columns are missing: {', '.join(absent)}")
    return found


def judged_prices(raw: DataFrame, aliases: Mapping[str, Sequence[str]] = PRICE_NAMES) -> DataFrame:
    """(ticker, date, close, problem, rows): one row for each ticker, day and problem of a price table.

    Tickers are trimmed and in capitals. problem, the first that holds: no_ticker, no_date, bad_date, bad_close (no
    number), close_not_positive (nor finite), repeated (several sound rows of one day); null is sound, and only then
    is there a close. Rows are counted before the shuffle, so a ticker or a problem of any size is no hot key.
    """
    at = resolved(raw.columns, aliases)
    day, close = _text(at["date"]), _text(at["close"]).try_cast("double")
    rows = raw.select(F.upper(_text(at["ticker"])).alias("ticker"), any_date(day).alias("date"), close.alias("close"), (day == "").alias("__none"))
    problem = (
        F.when(F.col("ticker") == "", "no_ticker").when(F.col("__none"), "no_date").when(F.col("date").isNull(), "bad_date")
        .when(F.col("close").isNull(), "bad_close").when(~finite(F.col("close")) | (F.col("close") <= 0), "close_not_positive")
    )
    days = rows.withColumn("problem", problem).groupBy("ticker", "date", "problem").agg(F.count("*").alias("rows"), F.min("close").alias("close"))
    said = F.coalesce("problem", F.when(F.col("rows") > 1, "repeated"))
    return days.select("ticker", "date", F.when(said.isNull(), F.col("close")).alias("close"), said.alias("problem"), "rows")


def read_prices(spark: SparkSession, path: str, aliases: Mapping[str, Sequence[str]] = PRICE_NAMES) -> DataFrame:
    """(ticker, date, close) of CSV files with a header; rows without ticker or date are skipped, any other problem, or
    no row at all, is a ContractError with counts."""
    raw = spark.read.option("header", True).option("escape", '"').option("maxCharsPerColumn", -1).csv(path)
    return _required(judged_prices(raw, aliases), ["no_ticker", "no_date"])


LINES = "path string, member string, line_no long, line string"


def archive_lines(files: DataFrame, *, encoding: str = "latin-1", rows: int = 10_000) -> DataFrame:
    """(path, member, line_no, line) of files (path, content): lines of the first file in a ZIP, or of the file itself.

    An archive without files, a broken one, or a null content gives one row of null member and line. A member is unpacked
    as a stream, ``rows`` lines at a time, so only the packed file has to fit in a task. Lines count from 1.
    """

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from _lines(path, content.as_py(), encoding, rows)

    return files.select("path", "content").mapInArrow(unpacked, LINES)


def _lines(path: str, content: bytes | None, encoding: str, rows: int) -> Iterator[pa.RecordBatch]:
    names = ["path", "member", "line_no", "line"]

    def batch(member: str | None, numbers: list[int], lines: list[str | None]) -> pa.RecordBatch:
        n = len(lines)
        return pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array([member] * n, pa.string()), pa.array(numbers, pa.int64()), pa.array(lines, pa.string())], names)

    try:
        if content is None:
            raise zipfile.BadZipFile
        if content[:2] == b"PK":
            archive = zipfile.ZipFile(io.BytesIO(content))
            member = next((i.filename for i in archive.infolist() if not i.is_dir()), None)
            if member is None:
                raise zipfile.BadZipFile
            stream = archive.open(member)
        else:
            member, stream = path.rpartition("/")[2], io.BytesIO(content)
        block, first = [], 1
        for line in io.TextIOWrapper(stream, encoding, errors="replace"):
            block.append(line.rstrip("\n"))
            if len(block) == rows:
                yield batch(member, list(range(first, first + rows)), block)
                first, block = first + rows, []
        if block:
            yield batch(member, list(range(first, first + len(block))), block)
    except zipfile.BadZipFile:
        yield batch(None, [0], [None])


def judged_factors(lines: DataFrame, names: Sequence[str], *, units: str = "percent") -> DataFrame:
    """(path, date, names..., problem, rows) of lines (path, line) that begin with a date (YYYYMMDD or ISO).

    Values are parted by commas or white space; percent become fractions, decimal stay. problem: no_file (a null line),
    short (too few values), bad_date, missing (a value that is no number, not finite, or of 90 or more), repeated; null
    is sound. Other lines are notes and give no row; so do further columns.
    """
    if units not in ("percent", "decimal"):
        raise ValueError("units are percent or decimal")
    parts = lines.where(r"line is null or line rlike '^\\s*(\\d{8}|\\d{4}-\\d{2}-\\d{2})'").select("path", "line", F.filter(F.split("line", r"[,\s]+"), lambda p: p != "").alias("p"))
    number = lambda k: F.get("p", F.lit(k + 1)).try_cast("double")
    value = lambda k: F.when(finite(number(k)) & (F.abs(number(k)) < SENTINEL), number(k) / (100.0 if units == "percent" else 1.0))
    rows = parts.select("path", "line", F.size("p").alias("__n"), any_date(F.get("p", F.lit(0))).alias("date"), *[value(k).alias(n) for k, n in enumerate(names)])
    empty = F.greatest(F.lit(0), *[F.col(f"`{n}`").isNull().cast("int") for n in names], F.lit(0)) == 1
    problem = F.when(F.col("line").isNull(), "no_file").when(F.col("__n") <= len(names), "short").when(F.col("date").isNull(), "bad_date").when(empty, "missing")
    days = rows.withColumn("problem", problem).groupBy("path", "date", "problem").agg(F.count("*").alias("rows"), *[F.min(f"`{n}`").alias(n) for n in names])
    said = F.coalesce("problem", F.when(F.col("rows") > 1, "repeated"))
    return days.select("path", "date", *[F.when(said.isNull(), F.col(f"`{n}`")).alias(n) for n in names], said.alias("problem"), "rows")


def read_factors(spark: SparkSession, path: str, names: Sequence[str], *, units: str = "percent") -> DataFrame:
    """(path, date, names...) of factor files, text or ZIP; lines that are short, of another date or with a missing value
    are skipped; a day twice in a file, a file that can't be read and no row at all are a ContractError."""
    files = spark.read.format("binaryFile").load(path)
    return _required(judged_factors(archive_lines(files), names, units=units), ["short", "bad_date", "missing"])


def read_submissions(spark: SparkSession, path: str, end: str = "</SEC-DOCUMENT>") -> DataFrame:
    """(text): one row a submission of files that hold many, each ended by ``end``. Files are split between tasks."""
    return spark.read.option("lineSep", end).text(path).select(F.col("value").alias("text")).where(F.col("text").rlike(r"\S"))


def header_fields(text: Column) -> Column:
    """struct (cik of ten digits, sic, filing_date) of a submission's header; a field that isn't there is null."""
    head = F.substring_index(F.substr(text, F.lit(1), F.lit(HEADER_CHARS)), HEADER_END, 1)
    said = {name: F.nullif(F.regexp_extract(head, pattern, 1), F.lit("")) for name, pattern in HEADER.items()}
    cik = F.when(F.length(said["cik"]) > 10, said["cik"]).otherwise(padded(said["cik"], 10))
    return F.struct(cik.alias("cik"), said["sic"].alias("sic"), F.try_to_date(said["filed"], "yyyyMMdd").alias("filing_date"))


def filing_history(filings: DataFrame, *, issuer: str, accession: str, text: str) -> DataFrame:
    """(issuer, accession, cik, sic, filing_date, problem): a row for each (issuer, accession), its header's fields.

    problem: no_cik, no_sic, no_date, other_issuer (the header names another than the ten-digit issuer that it is filed
    under); null is sound. Of repeated ones a sound row goes first, then the least fields.
    """
    rows = filings.select(F.col(issuer).alias("__issuer"), F.col(accession).alias("__accession"), header_fields(F.col(text)).alias("h"))
    problem = F.when(F.col("h.cik").isNull(), "no_cik").when(F.col("h.sic").isNull(), "no_sic").when(F.col("h.filing_date").isNull(), "no_date").when(~F.col("h.cik").eqNullSafe(F.col("__issuer")), "other_issuer")
    best = rows.select("*", problem.alias("problem")).groupBy("__issuer", "__accession").agg(F.min(F.struct(F.col("problem").isNotNull().alias("bad"), "h", "problem")).alias("x"))
    return best.select(F.col("__issuer").alias(issuer), F.col("__accession").alias(accession), "x.h.*", "x.problem")


def company_fields(payload: Column) -> Column:
    """struct of COMPANY_TAGS (hyphens as underscores): trimmed text of the first element of each local name, whatever its
    prefix; "" for an empty element, null for none. A payload that begins with '{' is JSON and has two of them.

    Comments don't count, CDATA and the five predefined references are decoded, null is all null.
    """
    xml = F.regexp_replace(F.regexp_replace(payload, r"(?s)<!--.*?-->", ""), r"(?s)<!\[CDATA\[([^<]*?)\]\]>", "$1")
    is_json = F.startswith(F.ltrim(payload), F.lit("{"))

    def first(tag: str) -> Column:
        pattern = rf"<(?:[\w.\-]+:)?{tag}(?:\s[^>]*?)?(?:/>|>([^<]*))"
        value = F.when(xml.rlike(pattern), F.regexp_extract(xml, pattern, 1))
        for ref, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            value = F.replace(value, F.lit(ref), F.lit(char))
        from_json = F.coalesce(F.get_json_object(payload, COMPANY_JSON[tag]), F.lit("")) if tag in COMPANY_JSON else F.lit(None).cast("string")
        return F.when(is_json, from_json).otherwise(F.regexp_replace(value, r"^\s+|\s+$", "")).alias(tag.replace("-", "_"))

    return F.struct(*[first(t) for t in COMPANY_TAGS])


def judged_terms(lines: DataFrame, term: str) -> DataFrame:
    """(term, problem, rows): the distinct lines of a strict dictionary. problem: blank, malformed (not its own lower-case
    words, parted by one space), repeated; null is sound. Null lines are blank."""
    line = F.coalesce(F.col(term), F.lit(""))
    rows = lines.select(line.alias("term")).groupBy("term").agg(F.count("*").alias("rows"))
    problem = F.when(F.trim("term") == "", "blank").when(F.array_join(scorer_tokens(F.col("term")), " ") != F.col("term"), "malformed").when(F.col("rows") > 1, "repeated")
    return rows.select("term", problem.alias("problem"), "rows")


def read_strict_terms(spark: SparkSession, path: str, count: int) -> DataFrame:
    """(term) of a file of exactly ``count`` sound and unique lines; anything else is a ContractError."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as gone:
        raise ContractError(f"there is no dictionary {path}") from gone
    terms = _required(judged_terms(lines, "value"))
    if (n := terms.count()) != count:
        raise ContractError(f"{n} terms, {count} were promised")
    return terms


def form_census(index: DataFrame, forms: Sequence[str], *, form_col: str = "form") -> DataFrame:
    """(form, n, wanted): rows of an index by form, all of them; null forms are one."""
    return index.groupBy(F.col(form_col).alias("form")).agg(F.count("*").alias("n")).withColumn("wanted", F.coalesce(F.col("form").isin(list(forms)), F.lit(False)))


def inventory(spark: SparkSession, roots: Sequence[str], layouts: Mapping[str, tuple[str, Sequence[str]]], *, glob: str = "*") -> DataFrame:
    """(root, path, bytes, modified, layout, keys...) of the files under the roots, whose contents are not read.

    layouts: name to (pattern, keys): the first whose pattern the path ends with gives the row its layout, and the
    pattern's groups its keys; files of no layout have nulls. Roots that aren't there are left out, and a file under several
    roots belongs to the first. Hidden files (. or _) are not listed.
    """
    keys = list(dict.fromkeys(k for _, names in layouts.values() for k in names))
    parts = []
    for place, root in enumerate(roots):
        try:
            files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
        except AnalysisException as gone:
            if gone.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        parts.append(files.select(F.lit(place).alias("__place"), F.lit(root).alias("root"), "path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")))
    if not parts:
        raise ContractError("none of the roots is there")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    if len(parts) > 1:
        found = found.groupBy("path").agg(F.min_by(F.struct("__place", "root", "bytes", "modified"), "__place").alias("x")).select("path", "x.*")
    layout = F.coalesce(*[F.when(F.col("path").rlike(f"(?:{p})$"), n) for n, (p, _) in layouts.items()], F.lit(None).cast("string"))
    value = lambda k: F.coalesce(*[F.when(F.col("layout") == n, F.regexp_extract("path", f"(?:{p})$", list(names).index(k) + 1)) for n, (p, names) in layouts.items() if k in names])
    return found.withColumn("layout", layout).select("root", "path", "bytes", "modified", "layout", *[value(k).alias(k) for k in keys])

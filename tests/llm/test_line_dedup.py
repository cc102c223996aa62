import duckdb
from lumenfold.llm import line_dedup as L
from pyspark.sql import functions as F


def brute_force(rows, sites):
    word = lambda x: x.strip(L.BLANKS) != ""
    seen = {}
    for _, text, site in rows:
        for x in (text or "").split("\n"):
            if word(x):
                seen.setdefault(x.strip(L.BLANKS), set()).add(site or "")
    out = []
    for i, text, _ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not word(x) or len(seen[x.strip(L.BLANKS)]) < sites]
        if not any(map(word, kept)):
            kept = lines
        out.append((i, None if text is None else "\n".join(kept), sum(map(word, lines)), len(lines) - len(kept)))
    return out


def test_spread_near_and_far_from_the_threshold(spark):
    own = "a line of its own, number {}, and long enough to be most of the text"
    rows = [(i, f"{own.format(i)}\n  every site says so \n\nten sites\r", f"s{i}") if i < 10 else (i, f"{own.format(i)}\nevery site says so\nnine{i % 9}", f"s{i}") for i in range(60)]
    rows += [(100 + i, "nine sites only\n" + own.format(i), f"n{i % 9}") for i in range(40)]
    rows += [(200, None, "s1"), (201, "", None), (None, "every site says so\n" + own, None), (3, "same id\nevery site says so", "s3"), (3, "same id\nevery site says so", "s3"), (300, "every site says so", "s1")]
    docs = spark.createDataFrame([(i, t, s, 1, "x") for i, t, s in rows], "doc_id long, text string, source string, h int, site string")
    got = [(r.doc_id, r.text, r["__lines"], r["__removed"]) for r in L.drop_boilerplate(docs).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(brute_force(rows, L.SITES), key=key)
    assert any("ten sites" in (t or "") for _, t, _ in rows) and not any("ten sites" in (t or "") for _, t, _, _ in got)
    assert sum("nine sites only" in (t or "") for _, t, _, _ in got) == 40
    assert L.drop_boilerplate(docs.limit(0)).count() == 0


def test_whole_table_equals_sql(spark, sf):
    got = {r.doc_id: (r.n_lines, r.n_removed, r.n_chars, r.text_sha256) for r in L.op10_line_dedup(spark, sf).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    wanted = {r[0]: r[1:] for r in con.sql(f"SELECT doc_id, n_lines, n_removed, n_chars, text_sha256 FROM ({L.OP10_SQL})").fetchall()}
    assert got == wanted and any(r[1] for r in got.values())
    table = spark.read.parquet(f"{sf}/documents.parquet")
    assert L.drop_boilerplate(table).drop("__lines", "__removed").columns == table.columns
    assert L.drop_boilerplate(table.withColumn("__id", F.lit(1))).count() == table.count()
    clashing = L.drop_boilerplate(table.withColumns({"__lines": F.lit(-1), "__row": F.lit(2), "h": F.lit(3)}))
    assert sorted(clashing.columns) == sorted([*table.columns, "__row", "h", "__lines", "__removed"])
    assert clashing.where("__lines < 0 or __row <> 2 or h <> 3").count() == 0

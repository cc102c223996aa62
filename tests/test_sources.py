import gzip
import json

from lumenfold.sources import readers as S


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n007,"two\nlines, ""quoted"""\n8,\n')
    assert [tuple(r) for r in S.read_delimited(spark, str(tmp_path / "a.csv"), ["id", "text"]).collect()] == [("007", 'two\nlines, "quoted"'), ("8", None)]
    (tmp_path / "i.idx").write_text("Notes\nCIK|name|form|date|file\n1|A|10-K|2011-01-01|x\n2|B|8-K|2011-01-02|y\n")
    assert [r.cik for r in S.read_pipe_index(spark, str(tmp_path / "i.idx"), ["cik", "name", "form", "date", "file"], forms=["10-K"]).collect()] == ["1"]
    (tmp_path / "f.txt").write_text("some notes\n20100104   1.50  -0.20 -99.99 0.001\n")
    r = S.read_factor_text(spark, str(tmp_path / "f.txt"), ["mkt", "smb", "hml", "rf"]).first()
    assert (str(r.date), r.mkt, r.hml) == ("2010-01-04", 0.015, None)
    (tmp_path / "p.json").write_text(json.dumps({"ticker": "X", "prices": {"2010-01-04": 5.0, "2010-01-05": -1.0, "1999-01-01": 2.0}}))
    assert [tuple(map(str, r)) for r in S.read_price_map(spark, str(tmp_path / "p.json"), first="2008-01-01", last="2021-12-31").collect()] == [("X", "2010-01-04", "5.0")]
    (tmp_path / "t.jsonl").write_text('{"term": "Supply  Chain", "max_cosine": 0.5}\n{"term": "supply chain", "max_cosine": 0.8}\n{"term": "x", "max_cosine": null}\n')
    assert [(r.term, r.weight, r.words) for r in S.read_weighted_terms(spark, str(tmp_path / "t.jsonl")).collect()] == [("supply chain", 0.8, ["supply", "chain"])]
    (tmp_path / "l.txt").write_text("# all\nRisk # one\nrisk\n\nother  term\n")
    assert {r.term for r in S.read_term_list(spark, str(tmp_path / "l.txt")).collect()} == {"risk", "other term"}
    (tmp_path / "c.json").write_text(json.dumps({"form": ["a", "b"], "n": [1, 2]}))
    assert [tuple(r) for r in S.read_columnar_json(spark, str(tmp_path / "c.json"), {"form": "string", "n": "int"}).collect()] == [("a", 1), ("b", 2)]
    (tmp_path / "e.json").write_text(json.dumps({"payload": {"symbol": "S", "quarter": "2010Q1", "transcript": [{"speaker": "A", "title": None, "content": "hi"}]}}))
    assert tuple(S.read_envelopes(spark, str(tmp_path / "e.json")).first()) == ("S", "2010Q1", 1, "A", None, "hi")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "s.txt").write_text("<DOCUMENT>\n<TYPE>EX-21.1\n<TEXT>ex</TEXT></DOCUMENT><DOCUMENT>\n<TYPE>10-K\n<TEXT>body</TEXT></DOCUMENT>")
    assert tuple(S.read_documents(spark, str(tmp_path / "d"), ["10-K", "10-K405"]).select("kind", "body").first()) == ("10-K", "body")
    with gzip.open(tmp_path / "w.gz", "wt") as f:
        f.write("a b\nc\n")
    assert [r.tokens for r in S.read_lines(spark, str(tmp_path / "w.gz")).collect()] == [["a", "b"], ["c"]]

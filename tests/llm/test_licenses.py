"""License scans against every block and every template in plain Python, and in SQL."""

import random
import re

import duckdb
import pytest

from lumenfold.llm import licenses as L

COLUMNS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(SMALL))


def brute(text, templates=L.TEMPLATES, containment=L.CONTAINMENT):
    words = cut(text)
    base = [(i, label) for label, p in L.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(cut(p))] == cut(p)]
    blocks = []
    for label, t in templates:
        own = cut(t)
        for s in range(0, len(words), len(own)):
            block = words[s : s + 2 * len(own)]
            share = len(set(own) & set(block)) / len(set(own))
            if share >= containment:
                blocks.append((label, s, len(block), share))
    at, labels = [i for i, _ in base], {x for _, x in base}
    return (len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {b[0] for b in blocks})), max((b[3] for b in blocks), default=0.0)), sorted(blocks)


def odd_texts():
    rng, out = random.Random(5), [None, "", " ", "cc by cc by cc BY", "All Rights\nReserved. General Public License", "É cc by é", "ﬁne\x00cc by", "released " * 5000 + "under the MIT license " + "x " * 5000, "the the the"]
    for label, t in L.TEMPLATES:
        words = t.split()
        for drop in (0, 1, 2, 4):
            own = [w for i, w in enumerate(words) if i not in rng.sample(range(len(words)), min(drop, len(words)))]
            out.append(" ".join(["lorem"] * rng.randrange(40) + own + ["ipsum"] * rng.randrange(40)))
        out.append("\n".join(words).upper())
    return [*out, out[3], out[12]]


@pytest.mark.parametrize("containment", [L.CONTAINMENT, 0.5, 1.0])
def test_blocks_equal_all_pairs(spark, containment):
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(texts)], "doc_id int, text string, labels string, n_words int").repartition(3)
    for r in L.license_scan(docs, containment=containment).collect():
        want, blocks = brute(texts[r.doc_id], containment=containment)
        assert tuple(r[c] for c in COLUMNS) == want
        assert sorted(tuple(b) for b in r.blocks) == blocks
    assert L.license_scan(docs.limit(0)).count() == 0


def test_order_follows_the_table_and_prefixes_are_the_rarest(spark):
    docs = spark.createDataFrame([("mit mit mit license the the",), ("the released",), (None,)], "text string")
    counts = L.word_counts(docs, [b"mit", b"license", b"the", b"under"])
    assert counts == {b"mit": 3, b"license": 1, b"the": 3, b"under": 0}
    index = L.Index([("x", "the MIT license under")], {}, 0.75, counts)
    assert [w for w, _ in sorted(index.number.items(), key=lambda x: x[1])] == [b"under", b"license", b"mit", b"the"]
    assert sorted(index.prefixes) == [0, 1]
    assert L.needed(10, 0.9) == 9 and L.needed(5, 0.9) == 5 and L.needed(3, 0.0) == 1


def test_whole_table_against_brute_force_and_sql(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = L.op11_license_scan(spark, sf).collect()
    assert len(rows) == len(docs) and all(tuple(r[c] for c in COLUMNS) == brute(docs[r.doc_id])[0] for r in rows)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet'")
    want = con.sql(f"SELECT doc_id, {', '.join(COLUMNS)} FROM ({L.OP11_SQL})").fetchall()
    assert sorted((r.doc_id, *[r[c] for c in COLUMNS]) for r in rows) == sorted(want)
    assert any(r.labels != r.base_labels for r in rows)

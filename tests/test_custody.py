"""Digests, frozen files and retention plans against plain Python; impact of families against subsets of pairs."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import custody as C
from lumenfold.operators import proximity as P
from lumenfold.operators.records import ContractError

sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def test_a_changed_byte_is_reported(spark, tmp_path):
    top = tmp_path / "kept files"
    for name, body in {"a.bin": b"one", "deep/b.bin": b"two" * 1000, "deep/c.txt": b"", "d.bin": b"four"}.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(body)
    frozen = spark.createDataFrame(C.pins(spark, str(top)).collect(), "path string, bytes long, digest string")
    assert {r.path: (r.bytes, r.digest) for r in frozen.collect()} == {"a.bin": (3, sha(b"one")), "deep/b.bin": (3000, sha(b"two" * 1000)), "d.bin": (4, sha(b"four"))}  # no row for c.txt
    assert C.pins(spark, str(top), pattern="*.txt").count() == 0
    root = C.root_digest(frozen, "path", F.col("digest")).first().root
    (top / "deep/b.bin").write_bytes(b"two" * 999 + b"twO")
    (top / "a.bin").unlink()
    (top / "d.bin").write_bytes(b"")
    (top / "new.bin").write_bytes(b"five")
    found = C.pins(spark, str(top))
    assert {r.path: r.state for r in C.verified(frozen, found).collect()} == {"a.bin": "missing", "deep/b.bin": "changed", "d.bin": "missing", "new.bin": "added"}
    assert C.root_digest(found, "path", F.col("digest")).first().root != root
    for bad in (frozen.union(frozen), spark.createDataFrame([(None, 1, "x")], frozen.schema)):
        with pytest.raises(ContractError):
            C.verified(frozen, bad)


def test_root_is_the_same_for_any_partitions(spark):
    rows = [(f"n{i % 40}", f"d{i % 7}") for i in range(120)] + [(None, "d"), ("n1", None), ("é", "d1")]
    df = spark.createDataFrame(rows, "name string, digest string")
    buckets = {}
    for n, d in rows:
        buckets.setdefault(sha(n or "")[: C.PREFIX], []).append((n or "", d or ""))
    lines = sorted((b, sha("\n".join(f"{d} {n}" for n, d in sorted(v)))) for b, v in buckets.items())
    wanted = (len(rows), len(buckets), sha("\n".join(f"{d} {b}" for b, d in lines)))
    for parts in (1, 9):
        assert tuple(C.root_digest(df.repartition(parts), "name", F.col("digest")).first()) == wanted
    assert tuple(C.root_digest(df.limit(0), "name", F.col("digest")).first()) == (0, 0, sha(""))


def test_nothing_that_a_kept_row_names_is_deleted(spark):
    rows = [("a", "x", "1", "valid"), ("a", "y", "1", "bad"), ("b", "a", "2", "bad"), ("b", None, "3", "bad"), (" ", "", "4", "bad"), ("c", "c", "5", None), ("d", "e", None, "bad"), ("f", "f", "6", "valid")]
    df = spark.createDataFrame(rows, "raw string, audio string, sha string, status string").withColumn("path", F.lit("own"))
    got = {r.path: (r.rows, r.kept_rows, r.digest, r.action) for r in C.retention_plan(df, {"raw": F.col("sha"), "audio": None}, F.col("status") == "valid").collect()}
    assert got == {
        "a": (3, 1, "1", "retain"), "x": (1, 1, None, "retain"), "y": (1, 0, None, "delete"), "b": (2, 0, None, "review"), "c": (1, 0, "5", "delete"),
        "d": (1, 0, None, "delete"), "e": (1, 0, None, "delete"), "f": (1, 1, "6", "retain"),
    }
    assert C.retention_plan(df.limit(0), {"raw": None}, F.lit(True)).count() == 0


def test_family_impact_equals_scoring_without_the_family(spark):
    rows = [(d, t, w) for d in range(12) for t, w in (("p", 0.5), ("q", 0.25), ("r", 1.0)) if (d + len(t + str(w))) % 3 or d % 4 == 0 for _ in range(1 + d % 3)]
    families = [("one", "p"), ("one", "q"), ("one", "q"), ("two", "q"), ("two", "r"), ("all", "p"), ("all", "q"), ("all", "r"), ("none", "z"), (None, "p"), ("three", None)]
    pairs = spark.createDataFrame(rows, "id long, term string, weight double")
    out = {r.family: r for r in P.family_impact(pairs, spark.createDataFrame(families, "family string, term string")).collect()}
    assert set(out) == {"one", "two", "all", "none"}
    for name, r in out.items():
        gone = {t for f, t in families if f == name}
        left, inside = [x for x in rows if x[1] not in gone], [x for x in rows if x[1] in gone]
        assert (r.terms, r.docs, r.n_pairs) == (len(gone), len({x[0] for x in inside}), len(inside))
        assert (r.nonzero, r.nonzero_without) == (len({x[0] for x in rows}), len({x[0] for x in left}))
        assert r.weight_without == pytest.approx(sum(x[2] for x in left))
    empty = P.family_impact(pairs.limit(0), spark.createDataFrame(families, "family string, term string")).collect()
    assert len(empty) == 4 and all((r.docs, r.nonzero, r.weight_without) == (0, 0, 0.0) for r in empty)


def test_top_terms_break_ties_by_pairs_then_terms(spark):
    rows = [(1, "b", 1.0), (1, "a", 0.5), (1, "a", 0.5), (1, "c", 1.0), (1, "d", 3.0), (2, "x", 0.1)]
    got = P.top_terms(spark.createDataFrame(rows, "id long, term string, weight double"), 3).collect()
    assert sorted((r.id, r["rank"], r.term, r.n) for r in got) == [(1, 1, "d", 1), (1, 2, "a", 2), (1, 3, "b", 1), (2, 1, "x", 1)]

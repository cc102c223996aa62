"""Discrepancy classes in their order, and blinded reviews against a draw in plain Python."""

import hashlib

import pytest

from lumenfold.operators import evaluation as E
from lumenfold.operators.records import ContractError


def test_the_first_reason_that_holds_names_the_class(spark):
    published = spark.createDataFrame([(t, "kept") for t in ["won", "absent", "rare", "unknown", "dropped", "nowhere", "other", "won"]] + [(None, "kept")], "term string, rank string")
    finals = spark.createDataFrame([("own", "won"), ("own", "won"), ("b", "won"), ("b", "other"), ("b", "dropped"), ("c", "other")], "method string, term string")
    ranked = spark.createDataFrame([("own", "dropped", 7), ("own", "dropped", 3), ("b", "nowhere", 1), ("own", "rare", 1)], "method string, term string, rank int")
    counts = spark.createDataFrame([("won", 9, False), ("rare", 4, True), ("unknown", 50, False), ("dropped", 20, True), ("dropped", 5, False), ("nowhere", 25, True), ("other", 25, True)], "term string, frequency long, in_vocabulary boolean")
    out = E.discrepancies(published, finals, ranked, counts, method="own", least=25).collect()
    assert len(out) == 9 and {r["rank"] for r in out} == {"kept"}
    got = {r.term: (r.recovered, r.best_rank, r.frequency, r.methods, r.reason, r.discrepancy_class) for r in out}
    assert got == {
        "won": (True, None, 9, 2, "recovered", ""), "absent": (False, None, 0, 0, "absent", "corpus"), None: (False, None, 0, 0, "absent", "corpus"), "rare": (False, 1, 4, 0, "below_least", "corpus"),
        "unknown": (False, None, 50, 0, "out_of_vocabulary", "corpus"), "dropped": (False, 3, 25, 1, "dropped_after_ranking", "preprocessing"),
        "nowhere": (False, None, 25, 0, "missed_by_all", "proprietary_algorithm"), "other": (False, None, 25, 2, "found_by_others", "model"),
    }
    assert E.discrepancies(published.limit(0), finals, ranked, counts, method="own", least=25).count() == 0


def test_sheet_hides_methods_and_judgements_meet_the_key(spark):
    rows = [("a", f"t{i}") for i in range(30)] + [("b", f"t{i}") for i in range(20, 26)] + [("c", None), (None, "t1")]
    df = spark.createDataFrame(rows, "method string, item string")
    sheet, key = E.blinded_review(df.repartition(5), method="method", item="item", per_method=10, salt="s")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    drawn = {m: sorted((t for n, t in rows if n == m and t), key=lambda t: sha(f"s|{t}"))[:10] for m in "ab"}
    assert sheet.columns == ["review_id", "item"]
    ids = {r.item: r.review_id for r in sheet.collect()}
    order = sorted({t for v in drawn.values() for t in v}, key=lambda t: sha(f"s|sheet|{t}"))
    assert ids == {t: f"R{i:09d}" for i, t in enumerate(order, 1)}
    assert sorted((r.method, r.item, r.review_id, r.seen) for r in key.collect()) == sorted((m, t, ids[t], {"a": 30, "b": 6}[m]) for m, v in drawn.items() for t in v)
    words = {t: ["relevant", "borderline", "not_relevant", "", None][i % 5] for i, t in enumerate(order)}
    filled = spark.createDataFrame([(ids[t], w) for t, w in words.items()], "review_id string, judgement string")
    for r in E.review_precision(filled, key, method="method").collect():
        mine = [words[t] for t in drawn[r.method]]
        done = [w for w in mine if w]
        assert (r.drawn, r.reviewed, r.relevant, r.borderline) == (len(mine), len(done), done.count("relevant"), done.count("borderline"))
        assert r.precision_strict == pytest.approx(done.count("relevant") / len(done))
        assert r.precision_lenient == pytest.approx((len(done) - done.count("not_relevant")) / len(done))
    assert {r.precision_strict for r in E.review_precision(filled.limit(0), key, method="method").collect()} == {None}
    for bad in (filled.union(filled), spark.createDataFrame([("R000000001", "good")], filled.schema)):
        with pytest.raises(ContractError):
            E.review_precision(bad, key, method="method")

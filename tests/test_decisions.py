"""Decision ledgers, overlays and evidenced periods on literal records."""

import pytest

from lumenfold.operators import decisions as D
from lumenfold.operators.records import ContractError


def decision(key="a", quarter="2014Q3", **more):
    base = {"call_id": key, "cik": "0001049521", "provider_quarter_label": quarter, "fiscal_period_label": quarter, "fiscal_period_end": "2014-03-31", "release_date": "2014-04-29", "status": "verified_correction", "source_url": "https://issuer.example/8-k", "evidence": "Issuer names the quarter, its end and the release.", "audit_flags": "", "transcript_status": "matched_issuer_period", "collision_adjudication": "", "collision_adjudication_url": ""}
    return base | more


def judged(spark, decisions, records=None):
    rows = records or [{"call_id": d["call_id"], "cik": "0001049521", "quarter_label": d["provider_quarter_label"]} for d in decisions]
    out = D.validated_decisions(spark.createDataFrame(rows), spark.createDataFrame(decisions, ", ".join(f"{c} string" for c in decision())))
    return {r.call_id: list(r.reasons) for r in out.collect()}


ADJUDICATED = {"collision_adjudication": "Two releases on one day.", "collision_adjudication_url": "https://issuer.example/both"}


@pytest.mark.parametrize(
    ("decisions", "want"),
    [
        ([decision()], {"a": []}),
        ([decision(), decision("b", "2014Q4")], {"a": ["shared_event_open"], "b": ["shared_event_open"]}),
        ([decision(**ADJUDICATED), decision("b", "2014Q4", **ADJUDICATED)], {"a": [], "b": []}),
        ([decision(**ADJUDICATED), decision("b", "2014Q4", **ADJUDICATED | {"collision_adjudication": "Another view."})], {"a": ["collision_disagrees"], "b": ["collision_disagrees"]}),
        ([decision(audit_flags="late;duplicate_issuer_release")], {"a": ["original_collision_open"]}),
        ([decision(transcript_status="invalid_issuer_or_period")], {"a": ["identity_unresolved"]}),
        ([decision(status="unresolved", release_date="", fiscal_period_end="", fiscal_period_label="", transcript_status="invalid_issuer_or_period")], {"a": []}),
        ([decision(status="unresolved")], {"a": ["unresolved_with_event"]}),
        ([decision(status="maybe", release_date="")], {"a": ["unknown_disposition"]}),
        ([decision(cik="0000002488")], {"a": ["other_issuer"]}),
        ([decision(evidence=None, source_url="")], {"a": ["lacks_evidence"]}),
        ([decision(release_date="2014-03-30")], {"a": ["predates_period"]}),
        ([decision(), decision("b", "2014Q4", fiscal_period_end="2014-04-01", release_date="2014-04-15")], {"a": [], "b": ["release_order"]}),
        ([decision(), decision("b", release_date="2014-05-29")], {"a": ["several_transcripts"], "b": ["several_transcripts"]}),
        ([decision(), decision()], {"a": ["repeated_call", "shared_event_open", "several_transcripts"]}),
    ],
)
def test_every_rejection(spark, decisions, want):
    assert judged(spark, decisions) == want


def test_coverage_provider_labels_and_the_error(spark):
    records = [{"call_id": "a", "cik": "0001049521", "quarter_label": "2014Q2"}, {"call_id": "c", "cik": "1", "quarter_label": "2014Q2"}]
    assert judged(spark, [decision(), decision("b", "2014Q4", cik="7")], records) == {"a": ["other_provider_call"], "b": ["unknown_call"], "c": ["missing_decision"]}
    labelled = [{"call_id": "a", "cik": "0001049521", "quarter_label": "2014Q2", "provider_quarter_label": "2014Q3"}]
    out = D.validated_decisions(spark.createDataFrame(labelled), spark.createDataFrame([decision()]))
    assert D.require_valid(out).count() == 1
    with pytest.raises(ContractError, match="1 rows: other_issuer"):
        D.require_valid(D.validated_decisions(spark.createDataFrame(labelled), spark.createDataFrame([decision(cik="2")])))


def test_overlay_takes_accepted_dates_only_and_clears_old_evidence(spark):
    rows = spark.createDataFrame([(k, "2014Q3", "2014-08-05", "2014-08-06", "press", "kept") for k in "abcz"], "call_id string, quarter_label string, call_date string, confirmed_call_date string, confirmed_call_date_source string, d string")
    over = spark.createDataFrame([decision(), decision("b", status="screened_existing"), decision("c", status="unresolved", release_date="")])
    got = {r.call_id: r for r in D.applied_decisions(rows, over).collect()}
    a, b, c, z = (got[k] for k in "abcz")
    assert (a.call_date, a.date_fiscal_date_ending, a.event_date_policy, a.confirmed_call_date, a.confirmed_call_date_source) == ("2014-04-29", "2014-03-31", "release", "", "")
    assert a.release_date_differs_from_confirmed_call is False and a.date_response_sha256 == "" and a.cell_sources["call_date"] == "decision" and a.cell_sources["confirmed_call_date"] == "cleared"
    assert b.confirmed_call_date == "2014-08-06" and b.cell_sources["confirmed_call_date"] == "original" and b.call_date == "2014-04-29"
    assert c.call_date == "" and c.date_status == "unresolved"
    assert z.call_date == "2014-08-05" and z.date_status is None and set(z.cell_sources.values()) == {"original"}
    with pytest.raises(ContractError):
        D.applied_decisions(rows, over.unionByName(over))


def test_periods_meet_exact_ends_only(spark):
    provider = spark.createDataFrame([("i", "2013-12-31", "2014-02-27"), ("i", "2014-12-31", "2015-01-29"), ("i", "2014-06-30", "2014-08-05"), ("i", "2015-03-31", "2015-04-29"), ("i", "2015-03-31", "2015-08-05"), ("i", "2016-03-31", "2016-03-01"), ("i", "2017-03-31", "")], "issuer string, fiscal_date_ending string, reported_date string")
    ends = ["2013-12-31", "2014-12-31", "2014-03-31", "2015-03-31", "2016-03-31", "2017-03-31"]
    periods = spark.createDataFrame([("i", f"q{k}", e, "https://issuer.example", "calendar") for k, e in enumerate(ends)] + [("i", "q9", "2013-12-31", "", "calendar")], "issuer string, quarter_label string, fiscal_period_end string, source_url string, evidence string")
    got = {r.quarter_label: (r.status, r.reported_date) for r in D.evidenced_periods(provider, periods, on=["issuer"]).collect()}
    assert got == {"q0": ("matched", "2014-02-27"), "q1": ("matched", "2015-01-29"), "q2": ("missing", None), "q3": ("ambiguous", None), "q4": ("predates", None), "q5": ("missing", None), "q9": ("lacks_evidence", None)}
    with pytest.raises(ContractError):
        D.evidenced_periods(provider, periods, on=["issuer"], strict=True)

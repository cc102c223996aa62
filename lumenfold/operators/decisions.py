"""Reviewed decisions on records: rules that say what is wrong with each, and an overlay that keeps where cells come from."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators.records import ContractError

#: Dispositions with an event, and the one without.
ACCEPTED = ["verified_correction", "verified_existing", "screened_existing"]
UNRESOLVED = "unresolved"
#: Transcripts that can't have an event, and the flag of a collision in the records.
UNIDENTIFIED = ["invalid_issuer_or_period", "unresolved_period"]
COLLISION_FLAG = "duplicate_issuer_release"
#: Fixed value: the fields that an accepted decision must fill.
EVIDENCE = ["fiscal_period_label", "fiscal_period_end", "release_date", "source_url", "evidence"]


def filled(name: str | Column) -> Column:
    """Neither null nor the empty string."""
    return F.coalesce((F.col(name) if isinstance(name, str) else name).cast("string"), F.lit("")) != ""


@dataclass
class Rules:
    """Named conditions in the order of their precedence; a row's verdict is the first that it breaks."""

    conditions: dict[str, Column] = field(default_factory=dict)

    def judged(self, df: DataFrame, *, verdict: str = "verdict", reasons: str = "reasons", passed: str = "accepted") -> DataFrame:
        """``df`` with every broken rule's name, and the first or ``passed``. A condition that is null is not broken."""
        found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in self.conditions.items()]))
        return df.withColumn(reasons, found).withColumn(verdict, F.coalesce(F.get(F.col(reasons), F.lit(0)), F.lit(passed)))


LEDGER_FIELDS = ["call_id", "cik", "provider_quarter_label", *EVIDENCE, "status", "audit_flags", "transcript_status", "collision_adjudication", "collision_adjudication_url"]


def validated_decisions(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row for each decision, and for each record without one: call_id, the decision's fields, verdict and reasons.

    records: call_id, cik, quarter_label and perhaps provider_quarter_label, which goes before it; decisions:
    LEDGER_FIELDS, of which missing ones count as empty. Rules, in this order: missing_decision, unknown_call,
    repeated_call, other_issuer, other_provider_call, unknown_disposition, lacks_evidence, predates_period,
    unresolved_with_event, original_collision_open, identity_unresolved, shared_event_open, collision_disagrees,
    several_transcripts, release_order. Nulls and empty strings are alike; a repeated record is one; within an issuer
    equal fiscal ends are ordered by call_id, and the later of two releases out of order is named.
    """
    own = decisions.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in decisions.columns else F.lit("")).alias(c) for c in LEDGER_FIELDS])
    label = F.coalesce(F.col("provider_quarter_label"), F.col("quarter_label")) if "provider_quarter_label" in records.columns else F.col("quarter_label")
    calls = records.select(F.col("call_id").cast("string").alias("__call"), F.col("cik").alias("__cik"), label.alias("__label")).dropDuplicates(["__call"])
    twice = own.groupBy("call_id").agg(F.count("*").alias("__times"))
    by_event = own.where(filled("release_date")).groupBy("cik", "release_date").agg(
        F.count("*").alias("__members"),
        F.count_if(~(filled("collision_adjudication") & filled("collision_adjudication_url"))).alias("__open"),
        F.count_distinct("collision_adjudication").alias("__opinions"),
    )
    accepted = F.col("status").isin(ACCEPTED)
    by_period = own.where(accepted).groupBy("cik", "fiscal_period_label").agg(F.count("*").alias("__transcripts"))
    order = Window.partitionBy("cik", "__event").orderBy("fiscal_period_end", "call_id")
    placed = own.withColumn("__event", accepted).withColumn("__earlier", F.when(F.col("__event"), F.lag("release_date").over(order)))
    met = placed.join(twice, "call_id", "left").join(by_event, ["cik", "release_date"], "left").join(by_period, ["cik", "fiscal_period_label"], "left")
    met = met.withColumn("__decided", F.lit(True)).join(calls, F.col("call_id") == F.col("__call"), "full_outer")
    day = lambda c: F.to_date(F.col(c))
    flagged = F.col("audit_flags").contains(COLLISION_FLAG)
    shared = F.col("__members") > 1
    rules = Rules(
        {
            "missing_decision": F.col("__decided").isNull(),
            "unknown_call": F.col("__decided") & F.col("__call").isNull(),
            "repeated_call": F.col("__times") > 1,
            "other_issuer": ~F.col("cik").eqNullSafe(F.col("__cik")) & F.col("__call").isNotNull() & F.col("__decided"),
            "other_provider_call": ~F.col("provider_quarter_label").eqNullSafe(F.col("__label")) & F.col("__call").isNotNull() & F.col("__decided"),
            "unknown_disposition": ~F.col("status").isin([*ACCEPTED, UNRESOLVED]),
            "lacks_evidence": accepted & ~_all([filled(c) for c in EVIDENCE]),
            "predates_period": accepted & (day("release_date") < day("fiscal_period_end")),
            "unresolved_with_event": ~accepted & filled("release_date"),
            "original_collision_open": flagged & ~(filled("collision_adjudication") & filled("collision_adjudication_url")),
            "identity_unresolved": accepted & F.col("transcript_status").isin(UNIDENTIFIED),
            "shared_event_open": shared & (F.col("__open") > 0),
            "collision_disagrees": shared & (F.col("__open") == 0) & (F.col("__opinions") > 1),
            "several_transcripts": accepted & (F.col("__transcripts") > 1),
            "release_order": accepted & (F.col("__earlier") > F.col("release_date")),
        }
    )
    return rules.judged(met).select(F.coalesce("call_id", "__call").alias("call_id"), *LEDGER_FIELDS[1:], "verdict", "reasons")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def require_valid(judged: DataFrame, passed: str = "accepted") -> DataFrame:
    """The judged rows, or a ContractError that counts the verdicts of those that break a rule."""
    broken = judged.where(F.col("verdict") != passed).groupBy("verdict").count().collect()  # a row a rule
    if broken:
        raise ContractError("; ".join(f"{r['count']} rows: {r.verdict}" for r in sorted(broken, key=lambda r: r.verdict)))
    return judged


def overlaid(base: DataFrame, over: DataFrame, on: str, cells: Mapping[str, Column], *, cleared: Mapping[str, Column] | None = None, sources: str = "cell_sources") -> DataFrame:
    """``base`` with cells from ``over`` (columns of it and of base, over's under the prefix "__d."), one row of over a key.

    A row that meets one takes each of ``cells``, and loses the columns of ``cleared`` where their condition holds.
    ``sources`` maps every touched column to "decision", "cleared" or "original". Rows that meet none stay as they are.
    Keys of over are unique, or a ContractError says so.
    """
    if over.groupBy(on).count().where("count > 1").limit(1).count():
        raise ContractError(f"{on} of the decisions is repeated")
    d = over.select(F.col(on).cast("string").alias("__on"), F.struct(*over.columns).alias("__d"))
    met = base.join(d, F.col(on).cast("string") == F.col("__on"), "left").drop("__on")
    hit, cleared = F.col("__d").isNotNull(), cleared or {}
    said, out = [], {}
    for name, cell in cells.items():
        before = F.col(name) if name in base.columns else F.lit(None).cast("string")
        out[name] = F.when(hit, cell).otherwise(before)
        said += [F.lit(name), F.when(hit, F.lit("decision")).otherwise("original")]
    for name, when in cleared.items():
        empty = F.lit("").cast(base.schema[name].dataType) if base.schema[name].dataType.typeName() == "string" else F.lit(None).cast(base.schema[name].dataType)
        gone = hit & F.coalesce(when, F.lit(False))
        out[name] = F.when(gone, empty).otherwise(F.col(name))
        said += [F.lit(name), F.when(gone, F.lit("cleared")).otherwise("original")]
    out[sources] = F.create_map(*said)
    return met.withColumns(out).drop("__d")


def applied_decisions(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """Records with the dates, labels and evidence of their decisions; only accepted ones give a release date.

    Evidence of a new source never keeps an old one's hash, and unless the decision only screened an existing date,
    confirmed call dates (columns confirmed_call_date and confirmed_call_date_*) are cleared.
    """
    missing = {c: F.lit("") for c in ("audit_flags", "source_sha256", "transcript_status", "fiscal_period_label") if c not in decisions.columns}
    over = decisions.withColumns(missing) if missing else decisions
    of = lambda c: F.coalesce(F.col(f"__d.{c}").cast("string"), F.lit(""))
    release = F.when(F.col("__d.status").isin(ACCEPTED), of("release_date")).otherwise("")
    anew = F.col("__d.status") != "screened_existing"
    cells = {
        "provider_quarter_label": of("provider_quarter_label"), "issuer_fiscal_period_label": of("fiscal_period_label"),
        "date_audit_status": of("status"), "date_audit_flags": of("audit_flags"), "date_audit_evidence": of("evidence"), "date_audit_source_url": of("source_url"),
        "transcript_identity_period_status": of("transcript_status"),
        "earnings_call_date": release, "reported_earnings_date": release, "call_date": release,
        "event_date_policy": F.lit("release"), "event_date_source_field": F.lit("earnings_call_date"),
        "date_fiscal_date_ending": of("fiscal_period_end"), "date_status": of("status"), "date_source_agreement": of("status"),
        "date_match_method": F.lit("audited_issuer_fiscal_period_release_evidence"),
        "date_source_url": of("source_url"), "call_date_source_url": of("source_url"),
        "date_response_sha256": of("source_sha256"), "call_date_source_sha256": of("source_sha256"),
        "date_evidence_snippet": of("evidence"), "call_date_evidence": of("evidence"),
    }
    old = lambda c, t: F.col(c) if c in records.columns else F.lit(None).cast(t)
    cells["call_date_confirmation_status"] = F.when(anew, "not_revalidated_in_release_date_audit").otherwise(old("call_date_confirmation_status", "string"))
    cells["release_date_differs_from_confirmed_call"] = F.when(anew, F.lit(False)).otherwise(old("release_date_differs_from_confirmed_call", "boolean"))
    confirmed = [c for c in records.columns if c == "confirmed_call_date" or c.startswith("confirmed_call_date_")]
    return overlaid(records.withColumns({c: old(c, "string") for c in cells if c not in records.columns and c != "release_date_differs_from_confirmed_call"}), over, "call_id", cells, cleared=dict.fromkeys(confirmed, anew))


def evidenced_periods(provider: DataFrame, periods: DataFrame, *, on: list[str], strict: bool = False) -> DataFrame:
    """Fiscal periods joined to a provider's release by their exact end: ``on``, quarter_label, fiscal_date_ending,
    reported_date, period_source_url, period_evidence, status.

    provider: on, fiscal_date_ending, reported_date; periods: on, quarter_label, fiscal_period_end, source_url,
    evidence. status: lacks_evidence (a field is empty; with ``strict`` a ContractError), missing (no release),
    ambiguous (several), predates (before the end) or matched; only the last has a date. No end is met by nearness.
    """
    evidence = _all([filled(c) for c in ("quarter_label", "fiscal_period_end", "source_url", "evidence")])
    if strict and (n := periods.where(~evidence).count()):
        raise ContractError(f"{n} periods lack source evidence")
    found = provider.where(filled("reported_date")).groupBy(*on, F.col("fiscal_date_ending").cast("string").alias("__end")).agg(F.min(F.col("reported_date").cast("string")).alias("__day"), F.count_distinct(F.col("reported_date").cast("string")).alias("__days"))
    met = periods.withColumn("__end", F.col("fiscal_period_end").cast("string")).join(found, [*on, "__end"], "left")
    status = F.when(~evidence, "lacks_evidence").when(F.col("__days").isNull(), "missing").when(F.col("__days") > 1, "ambiguous").when(F.to_date("__day") < F.to_date("__end"), "predates").otherwise("matched")
    return met.select(*on, "quarter_label", F.col("__end").alias("fiscal_date_ending"), F.when(status == "matched", F.col("__day")).alias("reported_date"), F.col("source_url").alias("period_source_url"), F.col("evidence").alias("period_evidence"), status.alias("status"))

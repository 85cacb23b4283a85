"""Hand-made observation sets with known verdicts."""

import pytest
from pyspark.sql import functions as F

from attest.functions.period import parse_period, sort_key
from attest.functions.text import currency_of, grouped, number_of, scale_of, value_of
from attest.operators.adjudicate import authoritative, diff
from attest.operators.findings import class_counts, readiness, top_by_pillar, verify
from attest.plans.rulepack import UNITS, RulePack

KIND = {"D": "pitch_deck", "F": "financial_statements", "M": "mis", "A": "auditor_notes", "K": "kpi_dashboard", "P": "projections", "C": "cap_table"}
Y = "FY2024-25"
MONTHS = [f"{m} {2024 if i < 9 else 2025}" for i, m in enumerate("apr may jun jul aug sep oct nov dec jan feb mar".split())]
SCHEMA = "session_id string, document_id string, filename string, document_category string, metric_key string, unit string, value_base double, currency string, period_raw string, basis_class string, subject string, quote string, conf_value double, conf_label double, conf_period double, conf_parse double, ordinal long"
CASES = {
    "deck_vs_auditor": [("D", "revenue", 52e6), ("A", "revenue", 32e6)],
    "marginal": [("F", "revenue", 32e6), ("M", "revenue", 33e6)],
    "weak": [("D", "revenue", 52e6, {"conf": 0.6, "parse": 0.55}), ("A", "revenue", 32e6)],
    "heads_near": [("M", "headcount", 42), ("K", "headcount", 45)],
    "heads": [("M", "headcount", 42), ("K", "headcount", 47)],
    "identity": [("D", "revenue", 52e6), ("D", "cogs", 31e6), ("D", "gross_profit", 24e6)],
    "single": [("D", "revenue", 52e6), ("D", "cash_position", 12e6)],
    "shares": [("C", "ownership", v, {"subject": s}) for s, v in zip("abcd", (52, 25, 10, 7), strict=True)],
    "growth": [("F", "revenue", v, {"period": p}) for p, v in (("FY23", 10e6), ("FY24", 12e6), ("FY25", 14.4e6))] + [("P", "revenue", 57.6e6, {"period": "FY26", "forward": True})],
    "no_growth": [("F", "revenue", v, {"period": p}) for p, v in (("FY23", 10e6), ("FY24", 12e6), ("FY25", 14.4e6))] + [("P", "revenue", 17.28e6, {"period": "FY26", "forward": True})],
    "ratio": [("F", "revenue", 320e6), ("F", "headcount", 3)],
    "dollars": [("D", "revenue", 625000, {"currency": "USD"}), ("F", "revenue", 32e6)],
    "year": [("M", "revenue", 1e6, {"period": p}) for p in MONTHS] + [("F", "revenue", 15e6)],
    "eight_months": [("M", "revenue", 1e6, {"period": p}) for p in MONTHS[:8]] + [("F", "revenue", 15e6)],
    "arr": [("D", "arr", 36e6), ("D", "mrr", 3e6), ("F", "mrr", 3e6)],
    "nothing": [("F", "revenue", None)],
}


@pytest.fixture(scope="module")
def observed(spark):
    rows, n = [], 0
    for session, cells in CASES.items():
        for d, metric, value, *more in cells:
            m = more[0] if more else {}
            unit = UNITS.get(metric, "currency")
            rows.append((session, d, f"{d}.pdf", KIND[d], metric, unit, None if value is None else float(value), m.get("currency"), m.get("period", Y), "forward" if m.get("forward") else "actual", m.get("subject"), "q", m.get("conf", 1.0), 1.0, 1.0, m.get("parse", 1.0), n))
            n += 1
    d = parse_period(spark.createDataFrame(rows, SCHEMA), "period_raw", "p")
    return d.select("*", *[F.col("p")[c].alias(c) for c in ("period_key", "granularity", "fy", "quarter", "month")], sort_key(F.col("p")).alias("sort_key")).drop("p", "period_raw").persist()


@pytest.fixture(scope="module")
def rates(spark):
    return spark.createDataFrame([("dollars", "USD", 83.2)], "session_id string, currency string, rate double")


@pytest.fixture(scope="module")
def checked(observed, rates):
    n, f = verify(observed, rates)
    return n.persist(), f.persist()


@pytest.fixture(scope="module")
def found(checked):
    return {(r.session_id, r.rule_id): r for r in checked[1].collect()}


@pytest.mark.parametrize(
    "session, rule, kind, severity, band",
    [
        ("deck_vs_auditor", "R1.cross_source.revenue", "VERIFIED_MISMATCH", 41.8, "CRITICAL"),
        ("marginal", "R1.cross_source.revenue", "UNRESOLVED_INCONSISTENCY", None, None),
        ("heads_near", "R1.cross_source.headcount", "VERIFIED_CONSISTENT", 0.0, "NONE"),
        ("heads", "R1.cross_source.headcount", "UNRESOLVED_INCONSISTENCY", 9.3, "MEDIUM"),
        ("identity", "R2.gross_profit", "VERIFIED_MISMATCH", 37.3, "CRITICAL"),
        ("shares", "R7.ownership_sum", "VERIFIED_MISMATCH", 26.6, "HIGH"),
        ("growth", "R4.growth.revenue", "UNUSUAL_ASSUMPTION_CHANGE", None, None),
        ("ratio", "R6.derived.revenue_per_employee", "VERIFIED_MISMATCH", None, None),
        ("dollars", "R1.cross_source.revenue", "VERIFIED_MISMATCH", None, "CRITICAL"),
        ("year", "R3.month_to_fy", "VERIFIED_MISMATCH", None, None),
        ("arr", "R5.derivable_not_stated", "MISSING_INFORMATION", None, None),
    ],
)
def test_verdicts(found, session, rule, kind, severity, band):
    r = found[session, rule]
    assert r.classification == kind
    assert severity is None or r.severity == severity
    assert band is None or r.severity_band == band


def test_weak_evidence_is_a_question(found):
    r = found["weak", "R1.cross_source.revenue"]
    assert (r.classification, r.classification_reason) == ("UNRESOLVED_INCONSISTENCY", "below_confidence_gate")


def test_silence(found):
    assert not [k for k in found if k[0] in ("no_growth",) and k[1].startswith("R4")]
    assert not [k for k in found if k[0] == "eight_months" and k[1].startswith("R3")]
    assert not [k for k in found if k[0] == "nothing"]


def test_score(checked):
    s = {r.session_id: r for r in readiness(*checked).collect()}
    assert (s["single"].ceiling, s["single"].score) == (58.6, 59)
    assert s["single"].base_score == 90.1
    assert all(0 <= r.score <= 100 for r in s.values())


def test_codes_are_unique(checked):
    f = checked[1]
    assert f.count() == f.select("session_id", "ref_code").distinct().count() == f.select("finding_id").distinct().count()
    assert class_counts(f).agg(F.sum("total")).first()[0] == f.count()
    assert top_by_pillar(f).where("rank > 3").count() == 0


def test_authoritative_document(observed, rates, checked):
    one = observed.where("session_id = 'deck_vs_auditor'")
    _, f = verify(authoritative(one, "A"), rates)
    d = diff(checked[1].where("session_id = 'deck_vs_auditor'"), f).where("before_severity is not null and after_severity is not null").collect()
    assert d and all(r.after_severity < r.before_severity for r in d)


def test_other_tolerance_does_not_leak(observed, rates):
    one = observed.where("session_id = 'marginal'")
    loose = RulePack().with_tolerance("revenue", 8.0)
    assert verify(one, rates, loose)[1].first().classification == "VERIFIED_CONSISTENT"
    assert verify(one, rates)[1].first().classification == "UNRESOLVED_INCONSISTENCY"


def test_periods(spark):
    want = {"FY26": "FY2025-26", "2025-26": "FY2025-26", "FY2025-2026": "FY2025-26", "March 2025": "M03-FY2024-25", "April 2025": "M04-FY2025-26", "Q3 FY25": "Q3-FY2024-25", "Projected Year 1": "REL-Y1", "2025": "FY2024-25", "the current financial year": "UNKNOWN", "03/2025": "M03-FY2024-25", "3Q25": "Q3-FY2024-25", "": "UNKNOWN"}
    d = parse_period(spark.createDataFrame([(k,) for k in want], "r string"), "r").select("r", "period.period_key")
    assert {r.r: r.period_key for r in d.collect()} == want


def test_figures(spark):
    want = {"Rs 5.2 Cr": (5.2, 1e7, "INR"), "Rs. 5.2 Cr": (5.2, 1e7, "INR"), "$1.5M": (1.5, 1e6, "USD"), "$2.4bn": (2.4, 1e9, "USD"), "45k": (45.0, 1e3, None), "5,20,00,000": (52000000.0, 1.0, None), "(3,200)": (-3200.0, 1.0, None), "-1.2 Cr": (-1.2, 1e7, None), "management fee 500": (500.0, 1.0, None), "increase of 300": (300.0, 1.0, None)}
    d = spark.createDataFrame([(k,) for k in want], "r string")
    r = F.col("r")
    assert {x.r: (x.n, x.s, x.c) for x in d.select("r", number_of(r).alias("n"), scale_of(r).alias("s"), currency_of(r).alias("c")).collect()} == want
    v = spark.createDataFrame([("Rs 5.2 Cr", 5.2), ("see note 4", 52e6)], "r string, m double").select(value_of(r, F.col("m"), F.lit("currency")).alias("v")).collect()
    assert [(x.v.value, x.v.reason) for x in v] == [(52e6, "model_missed_scale_multiplier"), (52e6, "value_raw_unparseable_used_model_value")]
    assert spark.createDataFrame([(52000000.0,)], "v double").select(grouped(F.col("v"))).first()[0] == "5,20,00,000"

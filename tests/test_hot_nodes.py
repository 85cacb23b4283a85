"""Nodes of very many observations: exact consensus and outliers without gathering them in a row."""

import random

import pytest
from pyspark.sql import functions as F

from attest.operators import adjudicate
from attest.operators.facts import halfway, nodes
from attest.operators.findings import evidence, verify
from attest.operators.rules import cross_source

COLUMNS = "session_id string, document_id string, filename string, document_category string, metric_key string, unit string, value_base double, currency string, period_key string, granularity string, fy int, quarter int, month int, sort_key int, basis_class string, subject string, quote string, conf_value double, conf_label double, conf_period double, conf_parse double, ordinal long"


def row(i, session, doc, value, weight=1.0, currency="INR", metric="revenue", subject=None):
    kind = {"deck": "pitch_deck", "fs": "financial_statements"}.get(doc, "mis")
    return (session, doc, doc, kind, metric, "currency", value, currency, "FY2024-25", "fy", 2024, None, None, 202400, "actual", subject, f"q{i}", weight, 1.0, 1.0, 1.0, i)


def plain_median(points):
    """(value, weight) pairs in order; the first at which the weights reach half."""
    units = [(v, round(max(w, 0.01) * 1e9)) for v, w in sorted(points)]
    whole, run = sum(w for _, w in units), 0
    for v, w in units:
        run += w
        if 2 * run >= whole:
            return v


def test_halfway(spark):
    r = random.Random(1)
    rows = [(k, float(r.choice([r.randrange(50), r.randrange(10**6)])), r.randrange(1, 9)) for k in ("hot", "b", None) for _ in range({"hot": 5000, "b": 7}.get(k, 40))] + [("one", 3.0, 1), ("tie", 1.0, 2), ("tie", 2.0, 2)]
    d = spark.createDataFrame(rows, "k string, v double, w long").repartition(5)
    want = {}
    for k in {x[0] for x in rows}:
        mine, run = sorted((v, w) for q, v, w in rows if q == k), 0
        for v, w in mine:
            run += w
            if 2 * run >= sum(w for _, w in mine):
                want[k] = v
                break
    assert {x.k: x.half for x in halfway(d, ["k"], "v", "w").collect()} == want
    assert halfway(d.limit(0), ["k"], "v", "w").count() == 0


@pytest.fixture(scope="module")
def hot(spark):
    r = random.Random(2)
    rows = [row(i, "s", r.choice(["deck", "fs", "mis"]), float(r.randrange(1000, 1100)), r.choice([0.0, 0.5, 1.0])) for i in range(3000)]
    rows += [row(5000 + i, "s", "fs", 2000.0 + i) for i in range(5)] + [row(6000, "t", "fs", 10.0, currency="EUR"), row(6001, "t", "deck", 11.0, currency="EUR"), row(6002, "u", "fs", None)]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def no_rates(spark):
    return spark.createDataFrame([], "session_id string, currency string, rate double")


@pytest.mark.parametrize("most", [10_000, 50])
def test_consensus_and_outliers(hot, no_rates, most):
    n = {(r.session_id, r.metric_key): r for r in nodes(hot, no_rates, most=most).collect()}
    rows = [r for r in hot.collect() if r.session_id == "s"]
    s = n["s", "revenue"]
    assert s.consensus == plain_median([(r.value_base, r.conf_value) for r in rows])
    far = [r for r in rows if abs(r.value_base - s.consensus) / s.consensus * 100 > 2.0]
    assert (s.n_obs, s.docs, s.n_outliers, s.dissenting) == (3005, 3, len(far), len({r.filename for r in far}))
    assert (s.low, s.high, s.confidence) == (1000.0, 2004.0, 0.0)
    assert len(s.obs) == 3  # a row has an entry for each document, however many observations
    for o in s.obs:
        mine = sorted(r.value_base for r in rows if r.document_id == o.document_id)
        assert (o.n, o.value_base) == (len(mine), mine[(len(mine) - 1) // 2])
        first, last = min((r.ordinal, r.value_base) for r in rows if r.document_id == o.document_id), max((r.ordinal, r.value_base) for r in rows if r.document_id == o.document_id)
        assert (o.ordinal, o.first_value, o.last, o.last_value) == (*first, *last)
    assert (n["t", "revenue"].blocked_reason, n["t", "revenue"].consensus) == ("currency_mismatch", None)
    assert (n["u", "revenue"].blocked_reason, n["u", "revenue"].docs) == ("no_value", 1)


def test_evidence_is_joined(hot, no_rates):
    _, f = verify(hot, no_rates, rules=(cross_source,))
    e = evidence(f, hot, no_rates)
    assert e.where("session_id = 's'").count() == 3005 and e.where("session_id = 't'").count() == 2
    assert {r.quote for r in e.collect()} == {r.quote for r in hot.where("session_id in ('s', 't')").collect()}


def test_findings_keep_their_identity(spark, hot, no_rates):
    before = verify(hot, no_rates, rules=(cross_source,))[1]
    loose = adjudicate.adjudicate(hot, no_rates, [adjudicate.Override("tolerance", metric_key="revenue", tolerance_pct=200.0)], rules=(cross_source,)).findings
    got = {r.session_id: r for r in adjudicate.diff(before, loose).collect()}
    assert (got["s"].change, got["s"].after_class) == ("reclassified", "VERIFIED_CONSISTENT") and set(got) == {"s"}
    # a rate moves the blocked node to another scope: still the same check of the same cell
    rated = adjudicate.adjudicate(hot, no_rates, [adjudicate.Override("fx_rate", "t", rates={"EUR": 90.0})], rules=(cross_source,)).findings
    moved = [r for r in adjudicate.diff(before, rated).collect() if r.session_id == "t"]
    assert [(r.change, r.before_class) for r in moved] == [("reclassified", "UNRESOLVED_INCONSISTENCY")]
    assert adjudicate.diff(before, before).count() == 0
    assert {r.change for r in adjudicate.diff(before, before.where("session_id = 't'")).collect()} == {"cleared"}
    assert {r.ref_code for r in before.where(F.col("session_id") == "s").collect()} == {"REV-R1-001"}

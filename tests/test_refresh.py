"""Settings by session as a table, and refreshes that check only what is out of date."""

import pytest
from pyspark.sql import functions as F

from attest.operators import rules
from attest.operators.findings import verify
from attest.plans.rulepack import RulePack
from attest.plans.settings import SETTING, settled
from attest.refresh import Ledger, fingerprint, refresh
from tests.test_verify import observed, rates  # noqa: F401

ASKED = ("session_id", "finding_id", "ref_code", "classification", "severity", "tolerance_pct", "delta_pct")
CHECKS = (rules.cross_source, rules.plausible)


def held(df, columns=ASKED):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_which_setting_counts(spark):
    own = spark.createDataFrame(
        [("a", "low", "m", 1.0, 1), ("a", "low", "m", 2.0, 3), ("a", "low", "m", 9.0, 2), (None, "low", "m", 5.0, 9), (None, "low", "m", 4.0, None), ("b", "low", "m", None, 7), ("c", "low", "m", 3.0, None), ("c", "low", "m", 2.5, None), ("a", "high", "m", 8.0, 9), ("a", "low", None, 7.0, 9)],
        SETTING,
    )
    df = spark.createDataFrame([("a", "m"), ("b", "m"), ("c", "m"), ("a", "other"), (None, "m"), ("a", None)], "session_id string, metric_key string")
    got = {(r.session_id, r.metric_key): r.v for r in settled(df, own, "low", "metric_key", "v").collect()}
    assert got == {("a", "m"): 2.0, ("b", "m"): 5.0, ("c", "m"): 3.0, ("a", "other"): None, (None, "m"): 5.0, ("a", None): None}
    assert settled(df, None, "low", "metric_key", "v").where("v is null").count() == 6
    assert settled(df, spark.createDataFrame([], SETTING), "low", "metric_key", "v").where("v is null").count() == 6


def test_tolerances_bands_and_weights_of_sessions(spark, observed, rates):  # noqa: F811
    own = spark.createDataFrame([("marginal", "tolerance", "revenue", 10.0, 1), ("heads", "weight", "R1", 30.0, 1), ("year", "high", "revenue", 14e6, 1), (None, "low", "headcount", 4.0, 1)], SETTING)
    pack = RulePack()
    _, plain = verify(observed, rates, pack, CHECKS)
    n, f = verify(observed, rates, pack.with_settings(own), CHECKS)
    before = {(r.session_id, r.rule_id): r for r in plain.collect()}
    after = {(r.session_id, r.rule_id): r for r in f.collect()}
    revenue = ("marginal", "R1.cross_source.revenue")
    assert (before[revenue].tolerance_pct, after[revenue].tolerance_pct, after[revenue].classification) == (2.0, 10.0, "VERIFIED_CONSISTENT")
    heads = ("heads", "R1.cross_source.headcount")
    assert after[heads].severity > before[heads].severity
    assert ("year", "R6.band.revenue") in after and ("year", "R6.band.revenue") not in before
    assert after["ratio", "R6.band.headcount"].computed == 4.0 and ("ratio", "R6.band.headcount") not in before
    untouched = set(before) - {revenue, heads}
    assert all(before[k] == after[k] for k in untouched) and len(untouched) > 2


def test_fingerprints_ignore_order_and_null_columns_alone(spark):
    kind = "session_id string, a string, b string"
    one = lambda rows, k=kind: {r.session_id: r.content for r in fingerprint(spark.createDataFrame(rows, k)).collect()}["s"]
    base = one([("s", "x", None), ("s", "y", "z")])
    assert base == one([("s", "y", "z"), ("s", "x", None)])
    assert base == one([("s", "y", "z", None), ("s", "x", None, None)], kind + ", c long")
    for other in ([("s", None, "x"), ("s", "y", "z")], [("s", "x", None), ("s", "y", "z"), ("s", "y", "z")], [("s", "x", None)], [("s", "x", ""), ("s", "y", "z")]):
        assert one(other) != base


@pytest.fixture
def ledger(spark, observed, tmp_path):  # noqa: F811
    made = Ledger.at(spark, f"file://{tmp_path}/ledger", buckets=4)
    made.observations.append(observed)
    return made


def acts(done):
    out = {}
    for r in done.collect():
        out.setdefault(r.action, set()).add(r.session_id)
    return out


def test_refresh_equals_a_full_run(spark, ledger, observed, rates):  # noqa: F811
    sessions = {r.session_id for r in observed.select("session_id").distinct().collect()}
    assert acts(refresh(ledger, rates, rules=CHECKS)) == {"checked": sessions}
    assert held(ledger.findings.read()) == held(verify(observed, rates, rules=CHECKS)[1])
    versions = [t.versions() for t in (ledger.nodes, ledger.findings, ledger.stamps)]
    assert acts(refresh(ledger, rates, rules=CHECKS)) == {"carried": sessions}
    assert versions == [t.versions() for t in (ledger.nodes, ledger.findings, ledger.stamps)]  # nothing was written

    mine = observed.where("session_id = 'marginal'")
    louder = mine.withColumn("value_base", F.when(F.col("document_id") == "M", 99e6).otherwise(F.col("value_base")))
    ledger.observations.replace(louder.unionByName(observed.where("session_id = 'heads'")), spark.createDataFrame([("single",)], "session_id string"))
    now = observed.where("session_id not in ('marginal', 'single')").unionByName(louder)
    done = acts(refresh(ledger, rates, rules=CHECKS))
    assert done == {"checked": {"marginal"}, "removed": {"single"}, "carried": sessions - {"marginal", "single"}}
    full_nodes, full = verify(now, rates, rules=CHECKS)
    assert held(ledger.findings.read()) == held(full)
    assert held(ledger.nodes.read(), ("session_id", "node_key", "consensus")) == held(full_nodes, ("session_id", "node_key", "consensus"))

    dearer = spark.createDataFrame([("dollars", "USD", 90.0), ("nobody", "USD", 1.0)], "session_id string, currency string, rate double")
    assert acts(refresh(ledger, dearer, rules=CHECKS))["checked"] == {"dollars"}
    own = RulePack().with_settings(spark.createDataFrame([("arr", "tolerance", "mrr", 7.0, 1)], SETTING))
    assert acts(refresh(ledger, dearer, own, CHECKS))["checked"] == {"arr"}
    assert acts(refresh(ledger, dearer, RulePack(version="2"), CHECKS)) == {"checked": sessions - {"single"}}
    assert held(ledger.findings.read()) == held(verify(now, dearer, rules=CHECKS)[1])


def test_a_refresh_opens_changed_buckets_alone(spark, ledger, observed, rates):  # noqa: F811
    refresh(ledger, rates, rules=CHECKS)
    seen = {r.source for r in ledger.stamps.read().select("source").distinct().collect()}
    rows, folders = ledger.observations.since(seen)
    assert rows is None and folders.count() == len(seen) > 1
    ledger.observations.replace(observed.where("session_id = 'arr'").withColumn("value_base", F.col("value_base") + 1))
    rows, _ = ledger.observations.since(seen)
    assert len({f.rsplit("/", 2)[1] for f in rows.inputFiles()}) == 1


def test_a_refresh_that_fails_is_done_again(spark, ledger, observed, rates):  # noqa: F811
    refresh(ledger, rates, rules=CHECKS)
    before = held(ledger.findings.read())

    def broken(n, pack):
        return rules.cross_source(n, pack).withColumn("metric_key", F.raise_error(F.lit("stop")).cast("string"))

    with pytest.raises(Exception, match="stop"):
        refresh(ledger, rates, rules=(broken,))
    assert held(ledger.findings.read()) == before
    assert "checked" not in acts(refresh(ledger, rates, rules=CHECKS))


def test_the_last_session_goes(spark, observed, rates, tmp_path):  # noqa: F811
    made = Ledger.at(spark, f"file://{tmp_path}/one", buckets=2)
    made.observations.append(observed.where("session_id = 'marginal'"))
    refresh(made, rates, rules=CHECKS)
    made.observations.replace(observed.limit(0), spark.createDataFrame([("marginal",)], "session_id string"))
    assert acts(refresh(made, rates, rules=CHECKS)) == {"removed": {"marginal"}}
    for table in (made.findings, made.nodes, made.stamps):
        held_now = table.read()
        assert held_now is None or held_now.isEmpty()
    assert refresh(made, rates, rules=CHECKS).isEmpty()

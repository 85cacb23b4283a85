"""What-if recomputation: overrides applied in order to copies, the whole check again, and the difference."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attest.operators.findings import check_of, pillars, readiness, verify
from attest.operators.rules import RULES
from attest.plans.rulepack import TOLERANCE_POINTS, RulePack
from attest.sources.session import once


@dataclass(frozen=True)
class Override:
    """kind: authoritative_source, fx_rate, tolerance or accept_explanation, with what that kind needs.

    rates maps currencies to rates; session_id is the session that is meant, all without one.
    """

    kind: str
    session_id: str | None = None
    document_id: str | None = None
    rates: dict[str, float] = field(default_factory=dict)
    metric_key: str | None = None
    tolerance_pct: float | None = None
    finding_ref: str | None = None
    note: str | None = None


@dataclass(frozen=True)
class Outcome:
    """nodes, findings and score after the overrides, and trail: (override, what it did) in order."""

    nodes: DataFrame
    findings: DataFrame
    score: DataFrame
    pillars: DataFrame
    trail: tuple[tuple[Override, str], ...]


def authoritative(obs: DataFrame, document_id: str, session_id: str | None = None) -> DataFrame:
    """The document's figures are certain; others on the cells that it covers count half."""
    mine = F.col("document_id") == document_id
    if session_id is not None:
        mine = mine & (F.col("session_id") == session_id)
    cell = ["session_id", "metric_key", "period_key", "basis_class", "subject"]
    o = obs.withColumn("subject", F.coalesce("subject", F.lit("-")))
    covered = o.where(mine).select(*cell).distinct().withColumn("covered", F.lit(True))
    o = o.join(covered, cell, "left")
    conf = F.when(mine, 1.0).when(F.col("covered"), F.col("conf_value") * 0.5).otherwise(F.col("conf_value"))
    return o.withColumn("conf_value", conf).select(*obs.columns)


def other_rates(rates: DataFrame, given: DataFrame) -> DataFrame:
    """Rates with those given in place of the session's own."""
    kept = rates.join(given, ["session_id", "currency"], "left_anti")
    return kept.unionByName(given.select(*rates.columns))


def accepted(findings: DataFrame, refs: DataFrame) -> DataFrame:
    """All findings, those in refs(session_id, ref_code, note) marked as accepted, without severity.

    What they were stays in original_severity and original_classification.
    """
    mark = refs.groupBy("session_id", "ref_code").agg(F.first("note", ignorenulls=True).alias("note"), F.lit(True).alias("__ok"))
    got = findings.join(mark, ["session_id", "ref_code"], "left")
    ok = F.coalesce("__ok", F.lit(False))
    changed = {"original_severity": F.when(ok, F.col("severity")), "original_classification": F.when(ok, F.col("classification")), "severity_band": F.when(ok, "MINOR").otherwise(F.col("severity_band")), "severity": F.when(ok, 0.0).otherwise(F.col("severity")), "accepted": ok}
    return got.withColumns(changed).drop("__ok")


def adjudicate(obs: DataFrame, rates: DataFrame, overrides: Sequence[Override], pack: RulePack = RulePack(), rules=RULES) -> Outcome:
    """Applies the overrides in their order to copies, verifies again, and scores without accepted findings.

    An override that lacks what its kind needs is left out, which the trail says. A tolerance is for
    all sessions, as the rule pack is.
    """
    trail, refs = [], []
    spark = obs.sparkSession
    for o in overrides:
        effect = None
        if o.kind == "authoritative_source" and o.document_id:
            obs, effect = authoritative(obs, o.document_id, o.session_id), f"{o.document_id} counts as certain"
        elif o.kind == "fx_rate" and o.rates:
            sessions = obs.select("session_id").distinct() if o.session_id is None else spark.createDataFrame([(o.session_id,)], "session_id string")
            pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("currency"), F.lit(float(r)).alias("rate")) for c, r in o.rates.items()]))
            given = sessions.select("session_id", pairs.alias("g")).select("session_id", "g.*")
            rates, effect = other_rates(rates.select("session_id", "currency", "rate"), given), "rates changed: " + ", ".join(f"{c} = {r}" for c, r in o.rates.items())
        elif o.kind == "tolerance" and o.metric_key and o.tolerance_pct is not None:
            before = pack.tolerance_pct.get(o.metric_key, TOLERANCE_POINTS.get(o.metric_key, pack.default_pct))
            pack, effect = pack.with_tolerance(o.metric_key, o.tolerance_pct), f"tolerance of {o.metric_key} changed from {before}% to {o.tolerance_pct}%"
        elif o.kind == "accept_explanation" and o.finding_ref and o.session_id:
            refs.append((o.session_id, o.finding_ref, o.note))
            effect = f"{o.finding_ref} accepted as explained, and out of the score"
        trail.append((o, effect or "ignored: it lacks what its kind needs"))
    n, f = verify(obs, rates, pack, rules)
    f = accepted(f, spark.createDataFrame(refs, "session_id string, ref_code string, note string"))
    counted = f.where("not accepted")
    return Outcome(n, f, readiness(n, counted), pillars(n, counted), tuple(trail))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Findings of two runs by what they check: appeared, cleared, reclassified or rescored.

    A finding keeps its finding_id when its outcome changes. What is left on either side (its node moved
    when a rate, a basis or a document changed) is paired by session, check, metric and period in order
    of severity; what then is still alone has appeared or cleared.
    """
    cell = ["session_id", "check", "metric_key", "period_key"]

    def pick(f: DataFrame, side: str) -> DataFrame:
        names = {"ref_code": "code", "classification": "class", "severity": "severity"}
        return f.select("finding_id", F.col("session_id"), check_of().alias("check"), "metric_key", F.coalesce("period_key", F.lit("-")).alias("period_key"), *[F.col(c).alias(f"{side}_{n}") for c, n in names.items()])

    b, a = once(pick(before, "before")), once(pick(after, "after"))
    same = b.join(a.drop(*cell), "finding_id")

    def left(f: DataFrame, other: DataFrame, side: str) -> DataFrame:
        order = W.partitionBy(*cell).orderBy(F.desc(f"{side}_severity"), f"{side}_code")
        return f.join(other.select("finding_id"), "finding_id", "left_anti").withColumn("nth", F.row_number().over(order))

    rest = left(b, a, "before").join(left(a, b, "after").withColumnRenamed("finding_id", "__id"), [*cell, "nth"], "full")
    rest = rest.withColumn("finding_id", F.coalesce("finding_id", "__id")).select(*same.columns)
    change = F.when(F.col("before_class").isNull(), "appeared").when(F.col("after_class").isNull(), "cleared").when(F.col("before_class") != F.col("after_class"), "reclassified").when(F.col("before_severity") != F.col("after_severity"), "rescored")
    return same.unionByName(rest).withColumn("change", change).where("change is not null").drop("check")


def score_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(session_id, score and band before and after, change) of two tables of readiness()."""
    pick = lambda d, p: d.select("session_id", F.col("score").alias(f"{p}_score"), F.col("band").alias(f"{p}_band"))
    return pick(before, "before").join(pick(after, "after"), "session_id").withColumn("change", F.col("after_score") - F.col("before_score"))


def pillar_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(session_id, pillar, before, after, change, changed): changed from a tenth on."""
    pick = lambda d, p: d.select("session_id", "pillar", F.col("pillar_score").alias(p))
    j = pick(before, "before").join(pick(after, "after"), ["session_id", "pillar"])
    step = F.floor((F.col("after") - F.col("before")) * 10 + 0.5) / 10
    return j.withColumns({"change": step, "changed": F.abs(step) >= 0.1})

"""Findings: severity, classification, resolution between rules, reference codes and the score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attest.functions.text import numbered, rounded
from attest.operators.facts import NODE, anchored, nodes, scale_anchor, tolerance_of
from attest.operators.rules import RULES
from attest.plans.rulepack import ABBREVIATIONS, BASE_WEIGHTS, DECK, FAVOURABLE_DOWN, FAVOURABLE_UP, IMPORTANCE, PILLARS, TIERS, RulePack, looked_up, unit_of
from attest.plans.settings import settled

CLASSES = ("VERIFIED_MISMATCH", "UNRESOLVED_INCONSISTENCY", "MISSING_INFORMATION", "UNUSUAL_ASSUMPTION_CHANGE", "VERIFIED_CONSISTENT")
_BLOCKING = ("currency_mismatch", "period_ambiguous", "basis_mismatch", "unit_unknown", "no_value")


def materiality(pack: RulePack) -> Column:
    """0.4 to 2: log-scaled excess over the tolerance and size against the session's anchor, by importance."""
    importance = F.coalesce(looked_up(F.col("metric_key"), IMPORTANCE), F.lit(0.5))
    unit = F.coalesce(unit_of(F.col("metric_key")), F.lit("currency"))
    tolerance = F.greatest(F.coalesce("tolerance_pct", "tolerance_abs", "own_tolerance", tolerance_of(F.col("metric_key"), F.lit("currency"), pack)[0]), F.lit(0.1))
    delta = F.abs(F.coalesce("delta_pct", "delta_abs"))
    rel = F.least(F.log10(1 + delta / tolerance) / F.log10(F.lit(1 + pack.saturation)), F.lit(1.0))
    size = F.abs("delta_abs")
    absolute = F.least(size / (0.05 * F.when(F.col("anchor") > 0, F.col("anchor"))), F.lit(1.0))
    blended = F.when((F.col("anchor") > 0) & (unit == "currency") & (size > 0), 0.6 * rel + 0.4 * absolute).otherwise(rel)
    value = F.when(delta.isNull(), 0.4 + 1.6 * importance).otherwise(0.4 + 1.6 * blended * importance)
    return F.least(F.greatest(value, F.lit(0.4)), F.lit(2.0))


def confidence() -> Column:
    weakest = F.least(F.lit(1.0), F.coalesce(F.array_min(F.transform("obs", lambda o: o["weight"])), F.lit(1.0)))
    return F.greatest(weakest * F.when(F.col("crossed_currency"), 0.9).otherwise(1.0), F.lit(0.0))


def direction() -> Column:
    """1.25 if the weaker side flatters, 0.85 if it understates, else 1."""
    up = F.when(F.col("metric_key").isin(*FAVOURABLE_UP), True).when(F.col("metric_key").isin(*FAVOURABLE_DOWN), False)
    identity = F.col("rule_class").isin("R2", "R3", "R7") & F.col("stated").isNotNull() & F.col("computed").isNotNull()
    own = F.filter("obs", lambda o: o["metric_key"] == F.col("metric_key"))
    tier = lambda o: (-F.coalesce(looked_up(o["document_category"], TIERS, "int"), F.lit(1))).alias("t")
    high = F.array_min(F.transform(own, lambda o: F.struct(tier(o), o["ordinal"].alias("i"), o["first_value"].alias("v"))))
    low = F.array_max(F.transform(own, lambda o: F.struct(tier(o), o["last"].alias("i"), o["last_value"].alias("v"))))
    differ = (high["t"] != low["t"]) & (high["v"] != low["v"])
    flatters = F.when(identity, F.when(F.col("stated") != F.col("computed"), (F.col("stated") > F.col("computed")) == up)).otherwise(F.when(differ, (low["v"] > high["v"]) == up))
    return F.when(flatters, 1.25).when(~flatters, 0.85).otherwise(1.0)


def corroboration() -> Column:
    """0.8 for an isolated outlier, 1.15 for a standoff, else 1."""
    out, all_ = F.coalesce("dissenting", F.lit(0)), F.coalesce("docs", F.lit(0))
    return F.when((all_ <= 1) | (out == 0), 1.0).when(out / F.when(all_ > 0, all_) <= 0.34, 0.8).otherwise(1.15)


def classified(pack: RulePack) -> tuple[Column, Column]:
    """(class, reason): the ladder in its fixed order; agreement comes before the confidence gate."""
    points = F.col("tolerance_abs").isNotNull()
    delta = F.when(points, F.abs("delta_abs")).otherwise(F.abs("delta_pct"))
    # differences of decimal figures carry binary noise; it must not decide at the tolerance itself
    delta = rounded(delta, 9)
    tolerance = F.coalesce("tolerance_abs", "tolerance_pct")
    weak = F.col("confidence") < pack.gate
    ladder = (
        (F.col("rule_class") == "R4", "UNUSUAL_ASSUMPTION_CHANGE", F.lit("fixed_by_rule_class")),
        (F.col("rule_class") == "R5", "MISSING_INFORMATION", F.lit("fixed_by_rule_class")),
        ((F.col("rule_class") == "R6") & weak, "UNRESOLVED_INCONSISTENCY", F.lit("plausibility_breach_low_confidence")),
        (F.col("rule_class") == "R6", "VERIFIED_MISMATCH", F.lit("plausibility_breach")),
        (F.col("blocked_reason").isin(*_BLOCKING), "UNRESOLVED_INCONSISTENCY", F.col("blocked_reason")),
        (delta.isNull() | tolerance.isNull(), "UNRESOLVED_INCONSISTENCY", F.lit("incomparable_values")),
        (delta <= tolerance, "VERIFIED_CONSISTENT", F.lit("within_tolerance")),
        (weak, "UNRESOLVED_INCONSISTENCY", F.lit("below_confidence_gate")),
        (delta <= tolerance * pack.unresolved, "UNRESOLVED_INCONSISTENCY", F.lit("marginal_variance")),
    )
    kind, why = F.lit("VERIFIED_MISMATCH"), F.lit("material_variance")
    for test, k, w in reversed(ladder):
        kind, why = F.when(test, k).otherwise(kind), F.when(test, w).otherwise(why)
    return kind, why


def scored(found: DataFrame, anchor: DataFrame, pack: RulePack) -> DataFrame:
    """Findings with factors, severity, band, class and pillar; confirmations have severity 0."""
    f = found.join(anchor, "session_id", "left")
    f = settled(settled(f, pack.own, "tolerance", "metric_key", "own_tolerance"), pack.own, "weight", "rule_class", "own_weight")
    f = f.withColumns({"base": F.coalesce("own_weight", looked_up(F.col("rule_class"), BASE_WEIGHTS)), "materiality": materiality(pack), "confidence": confidence(), "direction": direction(), "corroboration": corroboration()})
    kind, why = classified(pack)
    f = f.withColumns({"classification": kind, "classification_reason": why})
    raw = F.greatest(F.least(F.col("base") * F.col("materiality") * F.col("confidence") * F.col("direction") * F.col("corroboration"), F.lit(100.0)), F.lit(0.0))
    confirmed = F.col("classification") == "VERIFIED_CONSISTENT"
    band = F.when(confirmed, "NONE").when(raw >= 30, "CRITICAL").when(raw >= 18, "HIGH").when(raw >= 9, "MEDIUM").otherwise("MINOR")
    pillar = reduce(lambda c, p: c.when(F.col("rule_class").isin(*p[1][1]), p[0]), PILLARS.items(), F.when(F.lit(False), ""))
    return f.withColumns({"severity": F.when(confirmed, 0.0).otherwise(rounded(raw, 1)), "severity_band": band, "pillar": pillar}).drop("anchor", "own_tolerance", "own_weight")


def resolved(f: DataFrame) -> DataFrame:
    """Exact duplicates, derived checks of what an identity covers, and confirmations beside a problem go."""
    same = W.partitionBy("session_id", "rule_id", "metric_key", "period_key", "node_key", "result", "document_id").orderBy("ordinal")
    f = f.withColumn("rn", F.row_number().over(same)).where("rn = 1").drop("rn")
    cell = W.partitionBy("session_id", "metric_key", "period_key")
    f = f.withColumn("stated_too", F.max(F.col("rule_class") == "R2").over(cell)).where(~(F.col("rule_id").startswith("R6.derived") & F.col("stated_too")))
    f = f.withColumn("problem", F.max(F.col("classification") != "VERIFIED_CONSISTENT").over(cell))
    return f.where(~((F.col("classification") == "VERIFIED_CONSISTENT") & F.col("problem"))).drop("stated_too", "problem")


def check_of() -> Column:
    """What a finding checks, whatever came out: its rule_id without the parts that tell the outcome."""
    rule = F.col("rule_class")
    return F.when(rule.isin("R1", "R3", "R5"), rule).when(F.col("rule_id") == "R7.incomplete", "R7.ownership_sum").otherwise(F.regexp_replace("rule_id", r"\.combined$", ""))


def coded(f: DataFrame) -> DataFrame:
    """ref_code by descending severity within session, metric and rule; finding_id from what it is about.

    finding_id names the check and its cell, not the outcome: a finding that passes in another run keeps it.
    """
    abbreviation = F.coalesce(looked_up(F.col("metric_key"), ABBREVIATIONS, "string"), F.upper(F.substring("metric_key", 1, 4)))
    f = f.withColumn("prefix", F.concat_ws("-", abbreviation, "rule_class"))
    order = W.partitionBy("session_id", "prefix").orderBy(F.desc("severity"), "rule_class", "ordinal", "rule_id", "node_key", "document_id")
    code = F.concat(F.col("prefix"), F.lit("-"), numbered(F.row_number().over(order), 3))
    key = F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("-")) for c in (F.col("session_id"), check_of(), F.col("metric_key"), F.col("period_key"), F.col("node_key"), F.col("document_id"))]), 256)
    return f.withColumns({"ref_code": code, "finding_id": key}).drop("prefix")


def verify(obs: DataFrame, rates: DataFrame, pack: RulePack = RulePack(), rules=RULES) -> tuple[DataFrame, DataFrame]:
    """(nodes, findings) of all sessions in obs.

    Nodes are computed once, by checkpoints, as every rule reads them several times. Several rules'
    findings are one union; a rule that can't be planned is an error, not a gap in the report.
    """
    n = nodes(obs, rates, pack)
    return n, findings_of(n, pack, rules)


def findings_of(n: DataFrame, pack: RulePack = RulePack(), rules=RULES) -> DataFrame:
    """The findings of nodes that are computed already."""
    found = reduce(DataFrame.unionByName, [r(n, pack) for r in rules])
    return coded(resolved(scored(found, scale_anchor(n), pack)))


def problems(f: DataFrame) -> DataFrame:
    """Findings that are no confirmations, most severe first."""
    return f.where("classification <> 'VERIFIED_CONSISTENT'").orderBy(F.desc("severity"), "ref_code")


def confirmations(f: DataFrame) -> DataFrame:
    return f.where("classification = 'VERIFIED_CONSISTENT'")


def evidence(f: DataFrame, obs: DataFrame, rates: DataFrame, pack: RulePack = RulePack()) -> DataFrame:
    """A row for each observation that a finding rests on: where it stands, what it says, and its converted value.

    Findings name nodes and documents; the observations, however many a node has, are joined by those here.
    place counts the finding's nodes and documents; within one, rows are in order of ordinal.
    """
    seen = f.select("session_id", "finding_id", "ref_code", F.posexplode("obs").alias("place", "o")).select("*", "o.node_key", "o.document_id").drop("o")
    a = anchored(obs, rates, pack).withColumn("node_key", F.concat_ws("|", *NODE[1:]))
    a = a.select("session_id", "node_key", "document_id", "ordinal", "filename", "metric_key", "value_base", F.col("cur").alias("currency"), "value_anchor", F.col("weight").alias("confidence"), "quote")
    return seen.join(a, ["session_id", "node_key", "document_id"])


def pillars(n: DataFrame, f: DataFrame) -> DataFrame:
    """(session_id, pillar, weight, severity, problems, applicable, pillar_score) of every session."""
    sessions = n.groupBy("session_id").agg(
        F.bool_or(F.col("docs") >= 2).alias("cross_doc_consistency"),
        (F.count_distinct("metric_key") >= 2).alias("arithmetic_integrity"),
        F.bool_or(F.exists("obs", lambda o: o["document_category"].isin(*DECK))).alias("evidence_coverage"),
        F.bool_or(F.col("basis_class") == "forward").alias("projection_credibility"),
        F.bool_or(F.col("metric_key").isin("ownership", "esop_pool")).alias("ownership_integrity"),
    )
    dims = F.explode(F.array(*[F.struct(F.lit(k).alias("pillar"), F.lit(w).alias("weight"), F.col(k).alias("has")) for k, (w, _) in PILLARS.items()]))
    every = sessions.select("session_id", dims.alias("p")).select("session_id", "p.*")
    sums = f.groupBy("session_id", "pillar").agg(F.sum("severity").alias("severity"), F.count_if(F.col("classification") != "VERIFIED_CONSISTENT").alias("problems"), F.count(F.lit(1)).alias("k"))
    out = every.join(sums, ["session_id", "pillar"], "left").withColumn("severity", F.coalesce("severity", F.lit(0.0)))
    return out.select("session_id", "pillar", "weight", "severity", F.coalesce("problems", F.lit(0)).alias("problems"), (F.col("has") | F.col("k").isNotNull()).alias("applicable"), rounded(100 * F.lit(40.0) / (40 + F.col("severity")), 1).alias("pillar_score"))


def readiness(n: DataFrame, f: DataFrame) -> DataFrame:
    """(session_id, base_score, ceiling, score, band): weighted pillar scores (100 where nothing applies) under the coverage ceiling."""
    p = pillars(n, f).groupBy("session_id").agg(F.sum(F.col("pillar_score") * F.col("weight")).alias("base"))
    cover = n.select("session_id", "docs", F.explode(F.transform("obs", lambda o: o["document_category"])).alias("kind"), "node_key")
    kinds = cover.groupBy("session_id").agg(F.count_distinct("kind").alias("kinds"))
    c = n.groupBy("session_id").agg((F.count_if(F.col("docs") >= 2) / F.count(F.lit(1))).alias("evidence")).join(kinds, "session_id")
    c = c.withColumn("ceiling", rounded(55 + 45 * (0.6 * F.col("evidence") + 0.4 * F.least(F.lit(1.0), F.col("kinds") / 5.0)), 1))
    s = c.join(p, "session_id", "left").withColumn("base", F.coalesce("base", F.lit(100.0)))
    s = s.withColumn("score", F.floor(F.least("base", "ceiling") + 0.5))
    band = F.when(F.col("score") >= 85, "READY").when(F.col("score") >= 70, "CONDITIONAL").when(F.col("score") >= 50, "MATERIAL_GAPS").otherwise("HIGH_RISK")
    return s.select("session_id", rounded(F.col("base"), 1).alias("base_score"), "ceiling", "score", band.alias("band"))


def class_counts(f: DataFrame) -> DataFrame:
    """Findings of each class for each session, as columns, and those of unsupported claims."""
    return f.groupBy("session_id").agg(F.count_if(F.col("rule_class") == "R5").alias("unsupported_claims"), *[F.count_if(F.col("classification") == k).alias(k.lower()) for k in CLASSES], F.count(F.lit(1)).alias("total"))


def top_by_pillar(f: DataFrame, k: int = 3) -> DataFrame:
    """The k most severe problems of each pillar."""
    w = W.partitionBy("session_id", "pillar").orderBy(F.desc("severity"), "ref_code")
    return f.where("classification <> 'VERIFIED_CONSISTENT'").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

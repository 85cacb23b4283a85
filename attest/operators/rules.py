"""The seven rules over fact nodes; each gives rows of one schema, FINDING.

Every rule groups or joins by session first, so many sessions are checked in one job. figures and words
hold what the explanation of a finding names beside its stated and computed values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attest.functions.text import figure_text, plain_number, rounded
from attest.operators.facts import currencies, unique_nodes
from attest.plans.rulepack import BANDS, DECK, FLOWS, GROWTH_METRICS, MARGIN_METRICS, NEW_INVESTOR, OPTION_POOL, RulePack, looked_up, unit_of
from attest.plans.settings import settled

FINDING = {
    "session_id": "string", "rule_class": "string", "rule_id": "string", "metric_key": "string", "period_key": "string", "node_key": "string",
    "document_id": "string", "stated": "double", "computed": "double", "delta_abs": "double", "delta_pct": "double", "tolerance_pct": "double",
    "tolerance_abs": "double", "result": "string", "blocked_reason": "string", "detail": "string", "obs": None, "docs": "long",
    "dissenting": "long", "crossed_currency": "boolean", "ordinal": "long", "figures": "map<string,double>", "words": "map<string,string>",
}
COMPARABLE = "period_key is not null and period_key <> 'UNKNOWN'"


def _rows(df: DataFrame, rule: str, **columns: Column | str) -> DataFrame:
    out = []
    for name, kind in FINDING.items():
        c = columns.get(name)
        c = F.lit(rule) if name == "rule_class" else F.col(c) if isinstance(c, str) else c
        if c is None:
            c = F.col(name) if name in df.columns else F.lit(None)
        out.append((c.cast(kind) if kind else c).alias(name))
    return df.select(*out)


def _map(kind: str, **values: Column) -> Column:
    """A map of those values that are not null."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.cast(kind).alias("value")) for k, v in values.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def fx_note(obs: Column) -> Column:
    """The distinct rates by which a node's values were converted, null without one."""
    crossed = F.filter(F.flatten(F.transform(obs, lambda o: o["currencies"])), lambda c: (c["cur"] != "INR") & c["rate"].isNotNull())
    rates = F.array_distinct(F.transform(crossed, lambda c: F.concat(c["cur"], F.lit("_INR @ "), plain_number(c["rate"], 4))))
    return F.when(F.size(rates) > 0, F.concat(F.lit("[converted using "), F.array_join(rates, ", "), F.lit("]")))


def gap_pct(stated: Column, computed: Column) -> Column:
    """The gap in percent of the larger magnitude; two zeros have none."""
    most = F.greatest(F.abs(stated), F.abs(computed))
    return F.when(most == 0, 0.0).otherwise(F.abs(stated - computed) / F.when(most != 0, most) * 100)


def cross_source(n: DataFrame, pack: RulePack) -> DataFrame:
    """R1: nodes that two documents or more state, against the tolerance; blocked nodes stay questions."""
    two = n.where("docs >= 2")
    free = F.col("blocked_reason").isNull()
    over = F.when(F.col("in_points"), F.col("spread_abs") > F.col("tolerance")).otherwise(F.coalesce(F.col("spread_pct") > F.col("tolerance"), F.lit(True)))
    return _rows(
        two,
        "R1",
        rule_id=F.when(free, F.concat(F.lit("R1.cross_source."), "metric_key")).otherwise(F.concat(F.lit("R1.blocked."), "blocked_reason")),
        stated="high",
        computed="low",
        delta_abs="spread_abs",
        delta_pct="spread_pct",
        tolerance_pct=F.when(~F.col("in_points"), F.col("tolerance")),
        tolerance_abs=F.when(F.col("in_points"), F.col("tolerance")),
        result=F.when(~free, "BLOCKED").when(over, "FAIL").otherwise("PASS"),
        words=_map("string", fx=F.when(free & (F.col("unit") == "currency"), fx_note(F.col("obs")))),
    )


def _terms(spark, pack: RulePack, derived: bool) -> DataFrame:
    """One row for each identity and operand, and one for its result; a fixed small table."""
    rows = []
    for i, x in enumerate(pack.identities):
        if x.derive_only == derived:
            for j, (sign, metric) in enumerate(x.terms):
                rows.append((i, x.id, x.kind, x.result, len(x.terms), j, sign, metric, float(x.scale), x.pct, x.points))
            rows.append((i, x.id, x.kind, x.result, len(x.terms), 99, 0, x.result, float(x.scale), x.pct, x.points))
    return spark.createDataFrame(rows, "identity int, id string, kind string, of string, need int, term int, sign int, metric_key string, scale double, pct double, points double")


def _evaluated(values: Column, kind: Column, scale: Column) -> Column:
    """The computed result from array<struct<term, sign, v>> sorted by term."""
    total = F.aggregate(values, F.lit(0.0), lambda t, x: t + x["sign"] * x["v"])
    ratio = F.try_divide(F.get(values, 0)["v"], F.get(values, 1)["v"]) * scale
    return F.when(kind == "linear", total).when(kind == "ratio", ratio).otherwise(F.get(values, 0)["v"] * scale)


def identities(n: DataFrame, pack: RulePack) -> DataFrame:
    """R2: identities whose operands and result all have unique nodes, per document where one has all.

    A relational division: terms joined by metric, grouped by identity, with as many terms as needed.
    """
    terms = F.broadcast(_terms(n.sparkSession, pack, False))
    one = unique_nodes(n.where(COMPARABLE))
    cell = ["session_id", "identity", "id", "kind", "of", "need", "scale", "pct", "points", "period_key", "basis_class"]
    held = one.join(terms, "metric_key")
    of_cell = W.partitionBy("session_id", "identity", "period_key", "basis_class")  # a term has one node: a few rows
    held = held.withColumn("k", F.count(F.lit(1)).over(of_cell)).where("k = need + 1").drop("k")

    def found(rows: DataFrame, by: list[str], value: Column) -> DataFrame:
        g = rows.groupBy(*cell, *by).agg(
            F.array_sort(F.collect_list(F.when(F.col("term") < 99, F.struct("term", "sign", value.alias("v"), F.col("metric_key").alias("m"))))).alias("operands"),
            F.max(F.when(F.col("term") == 99, value)).alias("stated"),
            F.max(F.when(F.col("term") == 99, F.col("node_key"))).alias("node_key"),
            F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("term", "obs"))), lambda t: t["obs"])).alias("obs"),
            F.max(F.when(F.col("term") == 99, F.col("docs"))).alias("docs"),
            F.max(F.when(F.col("term") == 99, F.col("dissenting"))).alias("dissenting"),
            F.bool_or("crossed_currency").alias("crossed_currency"),
            F.count(F.lit(1)).alias("k"),
        )
        return g.where("k = need + 1").withColumn("computed", _evaluated(F.col("operands"), F.col("kind"), F.col("scale"))).where("computed is not null")

    own = held.withColumn("o", F.explode("obs"))  # a document's own value is in its entry
    per = own.select(*cell, "term", "sign", "metric_key", "node_key", "docs", "dissenting", "crossed_currency", F.col("o.document_id").alias("document_id"), F.col("o.value_base").alias("v"), F.array("o").alias("obs"))
    within = found(per, ["document_id"], F.col("v"))
    keys = ["session_id", "identity", "period_key", "basis_class"]
    across = found(held.join(within.select(*keys).distinct(), keys, "left_anti"), [], F.col("consensus")).withColumn("document_id", F.lit(None).cast("string"))
    both = within.unionByName(across, allowMissingColumns=True)
    mixed = F.size(currencies(F.col("obs"))) > 1
    delta = F.when(mixed, F.lit(None)).otherwise(F.col("stated") - F.col("computed"))
    pct = F.when(~mixed, gap_pct(F.col("stated"), F.col("computed")))
    passed = F.when(F.col("points").isNotNull(), F.abs(delta) <= F.col("points")).otherwise(pct <= F.col("pct"))
    parts = (F.col("operands"), F.col("kind"), F.col("scale"))
    culprit = likely_culprit(F.col("operands"), F.col("stated") - F.col("computed"), F.col("kind"), passed)
    return _rows(
        both,
        "R2",
        rule_id=F.concat(F.lit("R2."), "id", F.when(F.col("document_id").isNull(), ".combined").otherwise("")),
        metric_key="of",
        delta_abs=delta,
        delta_pct=pct,
        tolerance_pct="pct",
        tolerance_abs="points",
        result=F.when(mixed, "BLOCKED").when(passed, "PASS").otherwise("FAIL"),
        blocked_reason=F.when(mixed, "currency_mismatch"),
        detail=culprit["m"],
        figures=_map("double", culprit_needs=culprit["needed"]),
        words=_map("string", culprit=culprit["m"], expression=expression(*parts, F.col("of")), substituted=substitution(*parts, F.col("of"), F.col("computed"), F.col("stated"))),
        crossed_currency=F.lit(False),
        ordinal=F.col("identity").cast("long") * 1000,
    )


def likely_culprit(operands: Column, gap: Column, kind: Column, passed: Column) -> Column:
    """Of a failed sum, the operand for which the gap is the least share of its value: struct(m, needed)."""
    needed = lambda x: F.when(x["sign"] < 0, x["v"] - gap).otherwise(x["v"] + gap)
    shares = F.transform(F.filter(operands, lambda x: x["v"] != 0), lambda x: F.struct(F.abs(gap / x["v"]).alias("share"), x["term"].alias("term"), x["m"].alias("m"), needed(x).alias("needed")))
    return F.when((kind == "linear") & ~passed, F.array_min(shares))


def substitution(operands: Column, kind: Column, scale: Column, metric: Column, computed: Column, stated: Column) -> Column:
    """The identity with its figures put in, as an equation that can be checked by hand."""
    of = unit_of(metric)
    shown = lambda v, unit: figure_text(v, unit, F.lit("INR"))
    linear = F.array_join(F.transform(operands, lambda x, i: F.concat(F.when(i == 0, "").when(x["sign"] < 0, "- ").otherwise("+ "), shown(x["v"], of))), " ")
    one, two = F.get(operands, 0), F.get(operands, 1)
    times = F.concat(F.lit(" x "), plain_number(scale, 2))
    ratio = F.concat(shown(one["v"], unit_of(one["m"])), F.lit(" / "), shown(two["v"], unit_of(two["m"])), F.when(scale != 1, times).otherwise(""))
    left = F.when(kind == "linear", linear).when(kind == "ratio", ratio).otherwise(F.concat(shown(one["v"], of), times))
    return F.concat(left, F.lit(" = "), shown(computed, of), F.lit("   [document states "), shown(stated, of), F.lit("]"))


def expression(operands: Column, kind: Column, scale: Column, metric: Column) -> Column:
    """The identity in names of metrics."""
    linear = F.array_join(F.transform(operands, lambda x, i: F.concat(F.when(i == 0, "").when(x["sign"] < 0, "- ").otherwise("+ "), x["m"])), " ")
    times = F.when(scale != 1, F.concat(F.lit(" x "), plain_number(scale, 2))).otherwise("")
    ratio = F.concat(F.get(operands, 0)["m"], F.lit(" / "), F.get(operands, 1)["m"], times)
    return F.concat(F.when(kind == "linear", linear).when(kind == "ratio", ratio).otherwise(F.concat(F.get(operands, 0)["m"], times)), F.lit(" = "), metric)


def rollups(n: DataFrame, pack: RulePack) -> DataFrame:
    """R3: months or quarters that are complete, against the stated year or quarter; flows only."""
    one = unique_nodes(n.where(F.col("metric_key").isin(*FLOWS) & (F.col("subject") == "-") & F.col("fy").isNotNull()))
    keys = ["session_id", "metric_key", "basis_class", "fy"]
    routes = (("month", "fy", 12, 1), ("quarter", "fy", 4, 0), ("month", "quarter", 3, 2))
    out = []
    for small, large, need, order in routes:
        by = keys + (["quarter"] if large == "quarter" else [])
        parts = one.where(F.col("granularity") == small).groupBy(*by).agg(
            F.count_distinct(small).alias("k"),
            F.aggregate(F.array_sort(F.collect_list(F.struct("sort_key", "consensus"))), F.lit(0.0), lambda t, x: t + x["consensus"]).alias("computed"),
            F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("sort_key", "obs"))), lambda t: t["obs"])).alias("parts"),
            F.array_sort(F.collect_list(F.struct("sort_key", "period_key", "consensus"))).alias("components"),
        )
        got = one.where(F.col("granularity") == large).join(parts.where(F.col("k") == need), by)
        out.append(got.select(*one.columns, "computed", "parts", "components", F.lit(order).alias("route"), F.lit(f"R3.{small}_to_{large}").alias("rule_id")))
    both = reduce(DataFrame.unionByName, out).withColumn("obs", F.concat("parts", "obs")).withColumn("stated", F.col("consensus"))
    mixed = F.size(currencies(F.col("obs"))) > 1
    both = both.withColumn("result", F.when(mixed, "BLOCKED").when(gap_pct(F.col("stated"), F.col("computed")) <= pack.rollup_pct, "PASS").otherwise("FAIL"))
    first = W.partitionBy("session_id", "metric_key", "period_key", "basis_class").orderBy((F.col("result") != "FAIL").cast("int"), "route")
    best = both.withColumn("rn", F.row_number().over(first)).where("rn = 1")
    blocked = F.col("result") == "BLOCKED"
    gap = F.col("stated") - F.col("computed")
    nearest = F.array_min(F.transform("components", lambda c: F.struct(F.abs(F.abs(c["consensus"]) - F.abs(gap)).alias("far"), c["sort_key"].alias("sort_key"), c["period_key"].alias("period_key"), (c["consensus"] + gap).alias("needed"))))
    nearest = F.when((F.col("result") == "FAIL") & (gap != 0), nearest)
    return _rows(
        best,
        "R3",
        figures=_map("double", components=F.size("components"), culprit_needs=nearest["needed"]),
        words=_map("string", culprit_period=nearest["period_key"], grain=F.split("rule_id", "[._]")[1]),
        delta_abs=F.when(~blocked, F.col("stated") - F.col("computed")),
        delta_pct=F.when(~blocked, gap_pct(F.col("stated"), F.col("computed"))),
        tolerance_pct=F.lit(pack.rollup_pct),
        blocked_reason=F.when(blocked, "currency_mismatch"),
    )


def temporal(n: DataFrame, pack: RulePack) -> DataFrame:
    """R4: growth from the last actual year to the first later projection, and steps of margins."""
    year = n.where("granularity = 'fy' and fy is not null and consensus is not null and subject = '-'")
    point = F.struct("fy", "consensus", "period_key", "node_key", "obs", "docs", "n_outliers", "crossed_currency", "ordinal")
    by = ["session_id", "metric_key"]
    actual = year.where("basis_class = 'actual'").groupBy(*by).agg(F.max_by(point, "fy").alias("last"), F.min_by(point, "fy").alias("first"), F.max("consensus").alias("most"))
    ahead = year.where(F.col("basis_class") == "forward").join(actual, by)
    seam = ahead.where((F.col("fy") > F.col("last.fy")) & F.col("metric_key").isin(*GROWTH_METRICS)).groupBy(*by, "last", "first").agg(F.min_by(point, "fy").alias("next"))
    span, base, goal = F.col("next.fy") - F.col("last.fy"), F.col("last.consensus"), F.col("next.consensus")
    years = F.col("last.fy") - F.col("first.fy")
    sound = (base >= pack.growth_floor) & (goal > 0)
    implied = F.when(sound, (F.pow(goal / F.when(base > 0, base), F.lit(1.0) / span) - 1) * 100)
    begin = F.col("first.consensus")
    trailing = F.when((years > 0) & (begin >= pack.growth_floor), (F.pow(base / F.when(begin > 0, begin), F.lit(1.0) / F.when(years > 0, years)) - 1) * 100)
    seam = seam.withColumns({"implied": implied, "trailing": trailing}).where("implied > 0")
    flag = F.when(F.col("trailing").isNull(), F.col("implied") >= 100).when(F.col("trailing") <= 0, F.col("implied") >= pack.growth_pct).otherwise((F.col("implied") / F.when(F.col("trailing") > 0, F.col("trailing")) > pack.growth_ratio) & (F.col("implied") >= pack.growth_pct))
    why = F.when(F.col("trailing").isNull(), "no_trend").when(F.col("trailing") <= 0, "reversal_from_decline_to_growth").otherwise("growth_break")
    growth = _rows(
        seam.where(flag),
        "R4",
        rule_id=F.concat(F.lit("R4.growth."), "metric_key"),
        period_key=F.col("next.period_key"),
        node_key=F.col("next.node_key"),
        stated=F.col("implied"),
        computed=F.col("trailing"),
        delta_abs=goal - base,
        delta_pct=F.col("implied"),
        tolerance_pct=F.greatest(F.when(F.col("trailing").isNull(), pack.growth_pct).otherwise(F.col("trailing") * pack.growth_ratio), F.lit(1.0)),
        result=F.lit("FLAGGED"),
        figures=_map("double", implied=F.col("implied"), trailing=F.col("trailing"), ratio=F.col("implied") / F.when(F.col("trailing") > 0, F.col("trailing"))),
        detail=why,
        obs=F.concat(F.col("last.obs"), F.col("next.obs")),
        docs=F.col("next.docs"),
        dissenting=F.col("next.n_outliers"),
        crossed_currency=F.col("next.crossed_currency"),
        ordinal=F.col("next.ordinal"),
    )
    top = ahead.where(F.col("metric_key").isin(*MARGIN_METRICS)).groupBy(*by, "most").agg(F.max_by(point, F.struct("consensus", -F.col("fy"))).alias("peak"))
    step = F.col("peak.consensus") - F.col("most")
    margin = _rows(
        top.where(step > pack.margin_step),
        "R4",
        rule_id=F.concat(F.lit("R4.margin."), "metric_key"),
        period_key=F.col("peak.period_key"),
        node_key=F.col("peak.node_key"),
        stated=F.col("peak.consensus"),
        computed=F.col("most"),
        delta_abs=step,
        tolerance_abs=F.lit(pack.margin_step),
        result=F.lit("FLAGGED"),
        figures=_map("double", projected=F.col("peak.consensus"), best=F.col("most"), step=step),
        detail=F.lit("margin_step"),
        obs=F.col("peak.obs"),
        docs=F.col("peak.docs"),
        dissenting=F.col("peak.n_outliers"),
        crossed_currency=F.col("peak.crossed_currency"),
        ordinal=F.col("peak.ordinal"),
    )
    heads = actual.where("metric_key = 'headcount'").select("session_id", F.col("last.consensus").alias("h0")).join(
        year.where("metric_key = 'headcount' and basis_class = 'forward'").groupBy("session_id").agg(F.min_by("consensus", "fy").alias("h1")), "session_id"
    )
    burn = ahead.where((F.col("metric_key") == "burn_rate") & (F.col("fy") > F.col("last.fy"))).groupBy(*by, "last").agg(F.min_by(point, "fy").alias("next")).join(heads, "session_id", "left")
    drop = (base - goal) / F.when(base > 0, base) * 100
    cut = _rows(
        burn.where((drop > pack.burn_drop) & ~F.coalesce(F.col("h1") < F.col("h0"), F.lit(False))),
        "R4",
        rule_id=F.lit("R4.burn"),
        period_key=F.col("next.period_key"),
        node_key=F.col("next.node_key"),
        stated=goal,
        computed=base,
        delta_abs=base - goal,
        delta_pct=drop,
        tolerance_pct=F.lit(pack.burn_drop),
        result=F.lit("FLAGGED"),
        figures=_map("double", drop=drop),
        detail=F.when(F.col("h0").isNull(), "headcount_unknown").otherwise("headcount_does_not_fall"),
        obs=F.concat(F.col("last.obs"), F.col("next.obs")),
        docs=F.col("next.docs"),
        dissenting=F.col("next.n_outliers"),
        crossed_currency=F.col("next.crossed_currency"),
        ordinal=F.col("next.ordinal"),
    )
    return growth.unionByName(margin).unionByName(cut)


def unsupported(n: DataFrame, pack: RulePack) -> DataFrame:
    """R5: nodes that only decks state; detail names the first identity that other documents could derive it by."""
    deck = F.filter("obs", lambda o: o["document_category"].isin(*DECK))
    claims = n.where(F.col("metric_key") != "tam").withColumn("deck", deck).where("size(deck) > 0 and size(deck) = size(obs)")
    backed = unique_nodes(n.where(COMPARABLE)).withColumn("backing", F.aggregate(F.filter("obs", lambda o: ~o["document_category"].isin(*DECK)), F.lit(0).cast("long"), lambda t, o: t + o["n"]))
    terms = F.broadcast(_terms(n.sparkSession, pack, False).where("term < 99").withColumnRenamed("of", "result"))
    by = ["session_id", "identity", "id", "result", "need", "period_key", "basis_class"]
    able = backed.join(terms, "metric_key").groupBy(*by).agg(F.count(F.lit(1)).alias("k"), F.sum("backing").alias("backing")).where("k = need and backing >= need")
    able = able.groupBy("session_id", F.col("result").alias("metric_key"), "period_key", "basis_class").agg(F.min_by("id", "identity").alias("derivable"))
    got = claims.join(able, ["session_id", "metric_key", "period_key", "basis_class"], "left")
    got = got.join(documents_searched(n), "session_id", "left")
    return _rows(
        got,
        "R5",
        rule_id=F.when(F.col("derivable").isNull(), "R5.unsupported").otherwise("R5.derivable_not_stated"),
        stated="consensus",
        result=F.lit("UNSUPPORTED"),
        detail="derivable",
        figures=_map("double", searched=F.size(F.coalesce("searched", F.array().cast("array<string>")))),
        words=_map("string", searched=F.array_join("searched", ", "), derivation=F.col("derivable")),
        obs="deck",
    )


def documents_searched(n: DataFrame) -> DataFrame:
    """(session_id, searched): the names of each session's documents that are no decks."""
    other = n.select("session_id", F.explode(F.array_distinct(F.transform(F.filter("obs", lambda o: ~F.coalesce(o["document_category"].isin(*DECK), F.lit(False))), lambda o: o["filename"]))).alias("f"))
    return other.distinct().groupBy("session_id").agg(F.array_sort(F.collect_list("f")).alias("searched"))


def likely_cause(metric: Column, value: Column) -> Column:
    """A hint at how a figure may have come to lie outside its band, null without one."""
    unit, negative = unit_of(metric), value < 0
    share = F.when(negative, "sign of a bracketed figure").when(value > 10000, "amount in place of a percentage").when(value > 100, "percentage scaled twice")
    hints = ((unit == "pct", share), ((unit == "count") & negative, F.lit("sign of a bracketed figure")), (metric == "ltv_cac_ratio", F.lit("periods or units of the two values")), (metric == "cash_runway", F.lit("yearly burn taken for monthly")))
    return F.coalesce(*[F.when(test, hint) for test, hint in hints])


def _banded(rows: DataFrame, pack: RulePack) -> DataFrame:
    """rows with the ends of their metric's band, the session's own ones first."""
    ends = {name: looked_up(F.col("metric_key"), {k: v[i] for k, v in BANDS.items()}) for i, name in enumerate(("low", "high"))}
    for name in ends:
        rows = settled(rows, pack.own, name, "metric_key", f"band_{name}")
    return rows.withColumns({f"band_{name}": F.coalesce(f"band_{name}", end) for name, end in ends.items()})


def _breach(value: Column) -> tuple[Column, Column, Column]:
    low, high = F.col("band_low"), F.col("band_high")
    bound = F.when(value > high, high).when(value < low, low)
    return bound, F.when(value > high, "max").when(value < low, "min"), gap_pct(value, bound)


def plausible(n: DataFrame, pack: RulePack) -> DataFrame:
    """R6: stated values, and ratios that nobody states, outside their bands."""
    bound, side, pct = _breach(F.col("consensus"))
    stated = _rows(
        _banded(n, pack).where(bound.isNotNull()),
        "R6",
        rule_id=F.concat(F.lit("R6.band."), "metric_key"),
        stated="consensus",
        computed=bound,
        delta_abs=F.col("consensus") - bound,
        delta_pct=pct,
        tolerance_pct=F.lit(0.1),
        result=F.lit("FAIL"),
        detail=side,
        figures=_map("double", bound=bound),
        words=_map("string", cause=likely_cause(F.col("metric_key"), F.col("consensus"))),
    )
    one = unique_nodes(n.where(COMPARABLE))
    at = ["session_id", "period_key", "basis_class"]
    out = [stated]
    for x in pack.identities:
        if x.derive_only:
            top = one.where(F.col("metric_key") == x.terms[0][1])
            below = one.where(F.col("metric_key") == x.terms[1][1]).select(*at, F.col("consensus").alias("below"), F.col("obs").alias("more"))
            said = n.where(F.col("metric_key") == x.result).select(*at)
            got = top.join(below, at).join(said, at, "left_anti").withColumn("value", F.try_divide("consensus", "below") * x.scale)
            got = _banded(got.withColumn("metric_key", F.lit(x.result)), pack)
            bound, side, pct = _breach(F.col("value"))
            out.append(
                _rows(
                    got.where(bound.isNotNull()), "R6", rule_id=F.lit(f"R6.derived.{x.id}"), metric_key=F.lit(x.result), stated="value", computed=bound, delta_abs=F.col("value") - bound,
                    delta_pct=pct, tolerance_pct=F.lit(0.1), result=F.lit("FAIL"), detail=side, figures=_map("double", bound=bound),
                    words=_map("string", cause=likely_cause(F.lit(x.result), F.col("value"))), obs=F.concat("obs", "more"),
                )
            )
    return reduce(DataFrame.unionByName, out)


def cap_table(n: DataFrame, pack: RulePack) -> DataFrame:
    """R7: holders' shares against 100, a new investor's against the round, and the pool's against its holder."""
    at = ["session_id", "period_key", "basis_class"]
    free = n.where("blocked_reason is null")
    holders = free.where("metric_key = 'ownership' and subject <> '-'")
    pool = unique_nodes(free.where("metric_key = 'esop_pool'")).select(*at, F.col("consensus").alias("pool"), F.col("obs").alias("pool_obs"), F.col("node_key").alias("pool_key"), F.col("ordinal").alias("pool_ordinal"))
    g = holders.groupBy(*at).agg(
        F.aggregate(F.array_sort(F.collect_list(F.struct("ordinal", "consensus"))), F.lit(0.0), lambda t, x: t + x["consensus"]).alias("total"),
        F.count(F.lit(1)).alias("k"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "obs"))), lambda x: x["obs"])).alias("obs"),
        F.min_by("node_key", "ordinal").alias("node_key"),
        F.max("docs").alias("docs"),
        F.min("ordinal").alias("ordinal"),
    ).where("k >= 2").join(pool, at, "left")
    with_pool = F.abs(F.col("total") + F.col("pool") - 100) < F.abs(F.col("total") - 100)
    g = g.withColumn("stated", F.when(F.coalesce(with_pool, F.lit(False)), F.col("total") + F.col("pool")).otherwise(F.col("total")))
    gap = F.col("stated") - 100
    short = gap < -15
    shares = _rows(
        g, "R7", rule_id=F.when(short, "R7.incomplete").otherwise("R7.ownership_sum"), metric_key=F.lit("ownership"), computed=F.lit(100.0), delta_abs=gap, delta_pct=gap_pct(F.col("stated"), F.lit(100.0)),
        tolerance_abs=F.lit(pack.ownership_points), result=F.when(short, "BLOCKED").when(F.abs(F.floor(gap * 1e9 + 0.5) / 1e9) <= pack.ownership_points, "PASS").otherwise("FAIL"),
        blocked_reason=F.when(short, "unit_unknown"), figures=_map("double", holders=F.col("k")), dissenting=F.lit(0), crossed_currency=F.lit(False),
    )
    value = lambda m, name: unique_nodes(free.where(F.col("metric_key") == m)).select(*at, F.col("consensus").alias(name), F.col("obs").alias(f"{name}_obs"))
    new = holders.where(F.col("subject").rlike("|".join(NEW_INVESTOR)))
    single = new.groupBy(*at).agg(F.count(F.lit(1)).alias("k")).where("k = 1").select(*at)
    deal = new.join(single, at, "left_semi").join(value("round_size", "round"), at).join(value("post_money_valuation", "post"), at)
    deal = deal.withColumn("computed", F.try_divide("round", "post") * 100).where("computed is not null").withColumn("obs", F.concat("round_obs", "post_obs", "obs"))
    stake = _rows(
        deal, "R7", rule_id=F.lit("R7.new_investor"), stated="consensus", delta_abs=F.col("consensus") - F.col("computed"), delta_pct=gap_pct(F.col("consensus"), F.col("computed")),
        tolerance_abs=F.lit(pack.ownership_points), result=F.when(F.abs(rounded(F.col("consensus") - F.col("computed"), 9)) <= pack.ownership_points, "PASS").otherwise("FAIL"),
        figures=_map("double", round_size=F.col("round"), post_money=F.col("post")),
    )
    held = holders.where(F.col("subject").rlike("|".join(rf"\b{w}\b" for w in OPTION_POOL))).groupBy(*at).agg(F.min_by(F.struct("consensus", "obs"), "ordinal").alias("h"), F.max("docs").alias("docs")).join(pool, at)
    option = _rows(
        held, "R7", rule_id=F.lit("R7.esop_pool"), metric_key=F.lit("esop_pool"), node_key="pool_key", stated="pool", computed=F.col("h.consensus"), delta_abs=F.col("pool") - F.col("h.consensus"),
        delta_pct=gap_pct(F.col("pool"), F.col("h.consensus")), tolerance_abs=F.lit(pack.ownership_points), result=F.when(F.abs(rounded(F.col("pool") - F.col("h.consensus"), 9)) <= pack.ownership_points, "PASS").otherwise("FAIL"),
        obs=F.concat("pool_obs", F.col("h.obs")), dissenting=F.lit(0), crossed_currency=F.lit(False), ordinal="pool_ordinal",
    )
    return shares.unionByName(stake).unionByName(option)


#: Rules in the order in which their findings come; callers may pass others.
RULES = (cross_source, identities, rollups, temporal, unsupported, plausible, cap_table)

"""Observations to facts: one node for each claimed cell, with consensus, spread and outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attest.plans.rulepack import TOLERANCE_POINTS, RulePack, looked_up
from attest.plans.settings import settled
from attest.sources.session import once

NODE = ("session_id", "metric_key", "period_key", "basis_class", "currency_scope", "subject")


def tolerance_of(metric: Column, unit: Column, pack: RulePack) -> tuple[Column, Column]:
    """(tolerance, whether it is in points): points table, percent table, then the unit's default."""
    points, pct = looked_up(metric, TOLERANCE_POINTS), looked_up(metric, pack.tolerance_pct)
    in_points = points.isNotNull() | (pct.isNull() & (unit == "pct"))
    return F.coalesce(points, pct, F.when(unit == "pct", pack.default_points).otherwise(pack.default_pct)), in_points


def anchored(obs: DataFrame, rates: DataFrame, pack: RulePack) -> DataFrame:
    """Observations with currency_scope, value_anchor, weight and why they can't be compared.

    rates: (session_id, currency, rate), a small table for each session; of two rates for a currency
    the later in as_of counts, if the table has that column, else the larger.
    """
    base = pack.base_currency
    usable = rates.where((F.col("rate") > 0) & (F.col("currency") != base))
    latest = F.max_by("rate", F.struct("as_of", "rate")) if "as_of" in rates.columns else F.max("rate")
    usable = usable.groupBy("session_id", F.upper("currency").alias("currency")).agg(latest.alias("rate"))
    o = obs.withColumn("cur", F.upper(F.coalesce("currency", F.lit(base))))
    o = o.join(usable.withColumnRenamed("currency", "cur"), ["session_id", "cur"], "left")
    o = o.withColumn("rate", F.when(F.col("cur") == base, 1.0).otherwise(F.col("rate")))
    scope = F.when(F.col("unit") != "currency", "NA").when(F.col("rate").isNotNull(), "ANCHOR").otherwise(F.col("cur"))
    return o.withColumns(
        {
            "currency_scope": scope,
            "subject": F.coalesce("subject", F.lit("-")),
            "value_anchor": F.col("value_base") * F.col("rate"),
            "blocked": F.when(F.col("value_base").isNull(), "no_value").when(F.col("rate").isNull(), "currency_mismatch"),
            "weight": F.col("conf_value") * F.col("conf_label") * F.col("conf_period") * F.col("conf_parse"),
        }
    )


#: Weights are summed in whole billionths, so that sums don't depend on the order of tasks.
_UNITS = 1_000_000_000
_DOCUMENT = ("document_id", "filename", "document_category")


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """An equi-join by keys in which nulls are equal."""
    r = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return left.join(r, on, how).drop(*[f"__{k}" for k in keys])


def halfway(rows: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """(keys, half): for each key the least value at which the summed weight reaches half; weights are whole.

    Values are sorted by range over all keys, so a key of very many values goes over many ranges. The
    ranges' sums tell which range holds a key's half, and only that range is summed value by value.
    """
    each = rows.groupBy(*keys, value).agg(F.sum(weight).alias("w"))
    ranged = once(each.repartitionByRange(*keys, value).withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy(*keys, "part").agg(F.sum("w").alias("w"))
    of_key = W.partitionBy(*keys)
    run = F.sum("w").over(of_key.orderBy("part"))
    sums = sums.select(*keys, "part", (run - F.col("w")).alias("before"), run.alias("run"), F.sum("w").over(of_key).alias("whole"))
    holds = sums.where("2 * before < whole and 2 * run >= whole").drop("run")
    found = same_keys(ranged, holds, [*keys, "part"], "inner")
    run = F.col("before") + F.sum("w").over(of_key.orderBy(value))
    return found.withColumn("run", run).where("2 * run >= whole").groupBy(*keys).agg(F.min(value).alias("half"))


_KEPT = ("unit", "granularity", "fy", "quarter", "month", "sort_key")
#: Distinct values of a node that are folded in one row; nodes of more go over ranges of values.
MOST_VALUES = 10_000


def cells(obs: DataFrame, rates: DataFrame, pack: RulePack = RulePack()) -> DataFrame:
    """Equal statements of a document on a node as one row each, with how many they are; computed once."""
    a = anchored(obs, rates, pack)
    keys = (*NODE, *_KEPT, *_DOCUMENT, "cur", "rate", "value_base", "value_anchor", "blocked")
    units = F.round(F.greatest("weight", F.lit(0.01)) * _UNITS).cast("long")
    return once(a.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(units).alias("units"), F.min("weight").alias("weight"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last")))


def _half(points: Column) -> Column:
    """The least v of array<struct<v, w>> at which the weights, in order of v, reach half."""
    ordered = F.sort_array(points)
    whole = F.aggregate(points, F.lit(0).cast("long"), lambda t, p: t + p["w"])
    state = F.struct(F.lit(0).cast("long").alias("run"), F.lit(None).cast("double").alias("v"))
    step = lambda t, p: F.struct((t["run"] + p["w"]).alias("run"), F.coalesce(t["v"], F.when(2 * (t["run"] + p["w"]) >= whole, p["v"])).alias("v"))
    return F.when(F.size(points) == 1, F.get(points, 0)["v"]).otherwise(F.aggregate(ordered, state, step, lambda t: t["v"]))


def statements(c: DataFrame) -> DataFrame:
    """One row for each node and document: what the document says there, whatever often.

    high and low have the ordinal at which they stand; least and most are of the values as they are stated.
    """
    known = F.col("value_anchor").isNotNull()
    return c.groupBy(*NODE, *_DOCUMENT).agg(
        *[F.first(k).alias(k) for k in _KEPT],
        F.sum("n").alias("n"),
        F.min("weight").alias("weight"),
        F.min("first").alias("ordinal"),
        F.min("value_base").alias("least"),
        F.max("value_base").alias("most"),
        F.min_by("value_anchor", "first").alias("first_value"),
        F.max_by("value_anchor", "last").alias("last_value"),
        F.max("last").alias("last"),
        F.max(F.when(known, F.struct(F.col("value_anchor").alias("v"), (-F.col("first")).alias("at")))).alias("high"),
        F.min(F.when(known, F.struct(F.col("value_anchor").alias("v"), (-F.col("last")).alias("at")))).alias("low"),
        F.array_sort(F.collect_set(F.struct("cur", "rate"))).alias("currencies"),  # as many as there are currencies
        F.min(F.when(F.col("blocked").isNotNull(), F.struct("first", "blocked"))).alias("stop"),
    )


def _entry(mine: Column, node_key: Column, metric: Column) -> Column:
    """The entry of one document from its cells, which are in order of first."""
    total = lambda x, f: F.aggregate(x, F.lit(0).cast("long"), lambda t, c: t + c[f])
    one = F.get(mine, 0)
    known = F.filter(mine, lambda c: c["v"].isNotNull())
    last = F.array_max(F.transform(mine, lambda c: F.struct(c["last"].alias("last"), c["v"].alias("v"))))
    bases = F.transform(F.filter(mine, lambda c: c["b"].isNotNull()), lambda c: F.struct(c["b"].alias("v"), c["n"].alias("w")))
    fields = {
        "ordinal": one["first"], **{c: one[c] for c in _DOCUMENT}, "metric_key": metric, "node_key": node_key, "n": total(mine, "n"), "value_base": _half(bases),
        "weight": F.array_min(F.transform(mine, lambda c: c["weight"])), "currencies": F.array_sort(F.array_distinct(F.transform(mine, lambda c: F.struct(c["cur"].alias("cur"), c["rate"].alias("rate"))))),
        "first_value": one["v"], "last": last["last"], "last_value": last["v"],
        "high": F.array_max(F.transform(known, lambda c: F.struct(c["v"].alias("v"), (-c["first"]).alias("at")))), "low": F.array_min(F.transform(known, lambda c: F.struct(c["v"].alias("v"), (-c["last"]).alias("at")))),
    }
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def _entry_of_one(c: Column, node_key: Column, metric: Column) -> Column:
    """_entry() of a document's only cell."""
    known = lambda at: F.when(c["v"].isNotNull(), F.struct(c["v"].alias("v"), (-c[at]).alias("at")))
    fields = {
        "ordinal": c["first"], **{k: c[k] for k in _DOCUMENT}, "metric_key": metric, "node_key": node_key, "n": c["n"], "value_base": c["b"], "weight": c["weight"],
        "currencies": F.array(F.struct(c["cur"].alias("cur"), c["rate"].alias("rate"))), "first_value": c["v"], "last": c["last"], "last_value": c["v"], "high": known("first"), "low": known("last"),
    }
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def _bound(value: Column, f) -> Column:
    """f(value), the value computed once."""
    return F.transform(F.array(value), f)[0]


def _gathered(d: DataFrame) -> DataFrame:
    """Nodes of statements with value_base, without what their values' distribution tells."""
    said = F.struct("ordinal", *_DOCUMENT, "metric_key", "node_key", "n", "value_base", "weight", "currencies", "first_value", "last", "last_value", "high", "low")
    return d.withColumn("node_key", F.concat_ws("|", *NODE[1:])).groupBy(*NODE, "node_key").agg(
        *[F.first(k).alias(k) for k in _KEPT],
        F.array_sort(F.collect_list(said)).alias("obs"),
        F.sum("n").alias("n_obs"),
        F.min("stop").alias("stop"),
        F.min("low.v").alias("low"),
        F.max("high.v").alias("high"),
        F.least(F.lit(1.0), F.min("weight")).alias("confidence"),
        F.min("ordinal").alias("ordinal"),
    )


def _spread(g: DataFrame, half: Column, pack: RulePack) -> DataFrame:
    """Nodes with what follows from their entries and the half of their values."""
    distinct = lambda f: F.size(F.array_compact(F.array_distinct(F.transform("obs", lambda o: o[f])))).cast("long")
    g = g.withColumns({"blocked_reason": F.col("stop.blocked"), "docs": distinct("document_id"), "categories": distinct("document_category"), "crossed_currency": F.size(currencies(F.col("obs"))) > 1})
    free = F.col("blocked_reason").isNull()
    g = g.withColumns({"low": F.when(free, F.col("low")), "high": F.when(free, F.col("high"))}).drop("stop")
    tolerance, points = tolerance_of(F.col("metric_key"), F.col("unit"), pack)
    g = settled(g, pack.own, "tolerance", "metric_key", "own_tolerance")
    tolerance = F.coalesce("own_tolerance", tolerance)
    g = g.withColumns({"consensus": F.when(F.col("blocked_reason").isNull(), half), "spread_abs": F.col("high") - F.col("low"), "tolerance": tolerance, "in_points": points})
    size = F.abs("consensus")
    return g.drop("own_tolerance").withColumn("spread_pct", F.when(size > 0, F.col("spread_abs") / size * 100).when(F.col("spread_abs") == 0, 0.0))


def _far(value: Column) -> Column:
    """Whether a value of a node of several observations is further from its consensus than tolerated."""
    gap, size = F.abs(value - F.col("consensus")), F.abs("consensus")
    return F.when(F.col("in_points"), gap > F.col("tolerance")).when(size == 0, gap > 0).otherwise(gap / F.when(size > 0, size) * 100 > F.col("tolerance"))


def _folded(c: DataFrame, pack: RulePack) -> DataFrame:
    """Nodes of not too many distinct values: those meet in one row, and are folded there."""
    cell = F.struct("first", *_DOCUMENT, "cur", "rate", F.col("value_anchor").alias("v"), F.col("value_base").alias("b"), "n", F.col("units").alias("w"), "weight", "last", "blocked")
    blocked = F.when(F.col("blocked").isNotNull(), F.struct("first", "blocked"))
    sums = {"n_obs": F.sum("n"), "stop": F.min(blocked), "low": F.min("value_anchor"), "high": F.max("value_anchor"), "confidence": F.least(F.lit(1.0), F.min("weight"))}
    g = c.groupBy(*NODE).agg(*[F.first(k).alias(k) for k in _KEPT], F.sort_array(F.collect_list(cell)).alias("cells"), *[v.alias(k) for k, v in sums.items()]).withColumn("node_key", F.concat_ws("|", *NODE[1:]))
    g = g.withColumn("documents", F.array_distinct(F.transform("cells", lambda x: F.struct(*[x[k].alias(k) for k in _DOCUMENT]))))
    of = lambda d: F.filter("cells", lambda x: F.struct(*[x[k].alias(k) for k in _DOCUMENT]).eqNullSafe(d))
    names = F.col("node_key"), F.col("metric_key")
    several = F.transform("documents", lambda d: _bound(of(d), lambda mine: _entry(mine, *names)))
    # most documents say one thing on a node, which needs no search of its cells
    obs = F.when(F.size("documents") == F.size("cells"), F.transform("cells", lambda c: _entry_of_one(c, *names))).otherwise(several)
    known = F.transform(F.filter("cells", lambda x: x["v"].isNotNull()), lambda x: F.struct(x["v"].alias("v"), x["w"].alias("w")))
    zero = F.lit(0).cast("long")
    g = g.select(*NODE, "node_key", *_KEPT, "cells", F.sort_array(obs).alias("obs"), *sums, F.get("cells", 0)["first"].alias("ordinal"), _half(known).alias("half"))
    g = _spread(g, F.col("half"), pack).drop("half")
    wide = F.col("consensus").isNotNull() & (F.col("n_obs") > 1) & (F.col("low") < F.col("high"))
    g = g.withColumn("out", F.when(wide, F.filter("cells", lambda x: _far(x["v"]))))
    outliers, names = F.aggregate("out", zero, lambda t, x: t + x["n"]), F.size(F.array_distinct(F.transform("out", lambda x: x["filename"]))).cast("long")
    return g.withColumns({"n_outliers": F.when(wide, outliers).otherwise(zero), "dissenting": F.when(wide, names).otherwise(zero)}).drop("cells", "out")


def _ranged(c: DataFrame, pack: RulePack) -> DataFrame:
    """The same for nodes of any number of distinct values: no row holds them, and no task all of a node's."""
    keys = (*NODE, *_DOCUMENT)
    d = statements(c)
    several = same_keys(c.where("value_base is not null"), d.where("least < most").select(*keys), keys, "left_semi")
    d = same_keys(d, halfway(several, keys, "value_base", "n"), keys).withColumn("value_base", F.coalesce("half", "least")).drop("half")
    g = same_keys(_gathered(d), halfway(c.where("value_anchor is not null"), NODE, "value_anchor", "units"), NODE)
    g = once(_spread(g, F.col("half"), pack).drop("half"))
    wide = g.where("consensus is not null and n_obs > 1 and low < high").select(*NODE, "consensus", "tolerance", "in_points")
    out = same_keys(c, wide, NODE, "inner").where(_far(F.col("value_anchor"))).groupBy(*NODE, "filename").agg(F.sum("n").alias("n"))
    out = out.groupBy(*NODE).agg(F.sum("n").alias("n_outliers"), F.count(F.lit(1)).alias("dissenting"))
    return same_keys(g, out, NODE).withColumns({k: F.coalesce(k, F.lit(0)).cast("long") for k in ("n_outliers", "dissenting")})


def nodes(obs: DataFrame, rates: DataFrame, pack: RulePack = RulePack(), most: int = MOST_VALUES) -> DataFrame:
    """One row for each node, computed once; observations of a node that can't be converted block it.

    obs has an entry for each of the node's documents, so a row grows with the documents of a session but
    not with their observations; evidence() joins those by node and document. Nodes of more than `most`
    distinct values, if there are any, are computed over ranges of values; the results are the same.
    """
    c = cells(obs, rates, pack)
    hot = c.groupBy(*NODE).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > most).select(*NODE)
    if hot.isEmpty():
        return once(_folded(c, pack))
    hot = once(hot)
    apart = _folded(same_keys(c, hot, NODE, "left_anti"), pack)
    return once(apart.unionByName(_ranged(once(same_keys(c, hot, NODE, "left_semi")), pack)))


def currencies(obs: Column) -> Column:
    """The distinct currencies of entries of nodes' obs."""
    return F.array_distinct(F.flatten(F.transform(obs, lambda o: F.transform(o["currencies"], lambda c: c["cur"]))))


def parsed_rates(sessions: DataFrame, raw: str = "fx_rates") -> DataFrame:
    """(session_id, currency, rate) of sessions' rates as JSON objects like {"USD_INR": 83.2}; others are left out.

    What is no object gives no rows; rates must be positive numbers; source and as_of are no rates.
    """
    pairs = F.explode(F.map_entries(F.from_json(raw, "map<string,string>"))).alias("p")
    rate = F.col("p.value").try_cast("double")
    got = sessions.select("session_id", pairs).where(~F.col("p.key").isin("source", "as_of")).select("session_id", F.upper(F.regexp_replace("p.key", "(?i)_INR$", "")).alias("currency"), rate.alias("rate"))
    return got.where("rate > 0 and rate < double('infinity')")


def graph_stats(n: DataFrame) -> DataFrame:
    """Each session's observations, nodes, nodes of several documents, and blocked ones."""
    return n.groupBy("session_id").agg(
        F.sum("n_obs").alias("observations"), F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("docs") >= 2).alias("multi_source"), F.count_if(F.col("blocked_reason").isNotNull()).alias("blocked")
    )


def scale_anchor(n: DataFrame) -> DataFrame:
    """(session_id, anchor): the largest actual revenue or arr, else any of them, else any amount."""
    size = F.when(F.col("consensus") != 0, F.abs("consensus"))
    sales = F.col("metric_key").isin("revenue", "arr")
    return n.groupBy("session_id").agg(
        F.coalesce(F.max(F.when(sales & (F.col("basis_class") == "actual"), size)), F.max(F.when(sales, size)), F.max(F.when(F.col("unit") == "currency", size))).alias("anchor")
    )


def unique_nodes(n: DataFrame) -> DataFrame:
    """Nodes that are alone for their session, metric, period and basis, and have a value."""
    cell = W.partitionBy("session_id", "metric_key", "period_key", "basis_class")
    first, last = F.min("node_key").over(cell), F.max("node_key").over(cell)
    return n.withColumn("alone", first == last).where("alone and consensus is not null").drop("alone")

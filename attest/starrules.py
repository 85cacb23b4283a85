"""The rules, findings, score and what-if over a star schema, each with the same in DuckDB's SQL.

A nation is a session. Four documents report on it by fiscal year (mis by month as well): mis, fs, deck
and cap. Amounts are whole hundredths summed exactly, so both engines start from equal doubles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.functions.period import fiscal_quarter, fiscal_start, year_label
from attest.functions.text import rounded
from attest.operators import adjudicate, explain, facts, findings, rules, serving
from attest.plans.rulepack import RulePack
from attest.plans.settings import SETTING
from attest.refresh import Ledger, refresh
from attest.sources.session import once, shared

#: The first fiscal year that counts as a projection.
AHEAD = 1999
_WEIGHT = {"mis": 0.8, "fs": 1.0, "deck": 0.9, "cap": 1.0}
_CATEGORY = {"mis": "mis", "fs": "financial_statements", "deck": "pitch_deck", "cap": "cap_table"}


def observations(spark, d: str) -> DataFrame:
    """What the four documents say, in the columns of observations."""
    o, x, c = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("orders", "lineitem", "customer"))
    cents = lambda v: F.floor(v * 100 + 0.5)
    lines = x.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(cents(F.col("l_extendedprice"))).alias("gross"), F.sum(cents(F.col("l_extendedprice") * F.col("l_discount"))).alias("less"),
        F.sum(cents(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")))).alias("net"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.count(F.lit(1)).alias("lines"),
    )
    m = F.month("o_orderdate")
    j = o.join(lines, "o_orderkey").join(c, F.col("o_custkey") == F.col("c_custkey"))
    j = j.select(F.col("c_nationkey").cast("string").alias("session_id"), fiscal_start(m, F.year("o_orderdate")).cast("int").alias("fy"), m.cast("int").alias("month"), cents(F.col("o_totalprice")).alias("total"), "o_orderpriority", "gross", "less", "net", "quantity", "lines")
    keys, names = ("session_id", "fy"), ("total", "gross", "less", "net", "quantity", "lines")
    sums = [F.sum(k).alias(k) for k in names]
    # one grouping of the orders, written once: years, months and holders are sums of its few rows
    by = once(j.groupBy(*keys, "month", F.lower("o_orderpriority").alias("subject")).agg(*sums, F.count(F.lit(1)).alias("n")))
    people = o.join(x.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").cast("string").alias("session_id"), fiscal_start(m, F.year("o_orderdate")).cast("int").alias("fy"), "o_custkey")
    years = by.groupBy(*keys).agg(*sums).join(people.groupBy(*keys).agg(F.count_distinct("o_custkey").alias("people")), list(keys))
    months = by.groupBy(*keys, "month").agg(*sums)
    held = by.groupBy(*keys, "subject").agg(F.sum("n").alias("n"))
    held = held.join(by.groupBy(*keys).agg(F.sum("n").alias("all")), list(keys))

    def said(doc: str, metric: str, value: Column, number: int) -> Column:
        return F.struct(F.lit(doc).alias("document_id"), F.lit(metric).alias("metric_key"), value.alias("value_base"), F.lit(number).alias("number"))

    forward = F.col("fy") >= AHEAD
    by_year = F.array(
        said("fs", "revenue", F.col("gross") / 100, 1), said("deck", "revenue", F.when(forward, F.col("total") * 3).otherwise(F.col("total")) / 100, 2), said("deck", "customer_base", F.col("people").cast("double"), 3),
        said("mis", "headcount", F.col("lines").cast("double"), 4), said("mis", "ltv_cac_ratio", F.col("quantity") / F.col("lines"), 5),
    )
    by_month = F.array(said("mis", "revenue", F.col("gross") / 100, 6), said("mis", "cogs", F.col("less") / 100, 7), said("mis", "gross_profit", F.col("net") / 100, 8))
    none = F.lit(None).cast("int")
    y = years.select("session_id", "fy", none.alias("month"), F.explode(by_year).alias("s"), F.lit(None).cast("string").alias("subject"))
    q = months.select("session_id", "fy", "month", F.explode(by_month).alias("s"), F.lit(None).cast("string").alias("subject"))
    share = F.floor(F.col("n") * 1000 / F.col("all") + 0.5) / 10
    h = held.select("session_id", "fy", none.alias("month"), said("cap", "ownership", share, 9).alias("s"), "subject")
    e = y.unionByName(q).unionByName(h)
    doc, metric = F.col("s.document_id"), F.col("s.metric_key")
    of = lambda table: reduce(lambda w, p: w.when(doc == p[0], p[1]), list(table.items())[1:], F.when(doc == next(iter(table)), next(iter(table.values()))))
    unit = F.when(metric == "ownership", "pct").when(metric.isin("customer_base", "headcount"), "count").when(metric == "ltv_cac_ratio", "ratio").otherwise("currency")
    period = F.concat(F.when(F.col("month").isNotNull(), F.format_string("M%02d-", "month")).otherwise(""), year_label(F.col("fy")))
    one = F.lit(1.0)
    return e.select(
        "session_id", doc.alias("document_id"), doc.alias("filename"), of(_CATEGORY).alias("document_category"), metric.alias("metric_key"), unit.alias("unit"), F.col("s.value_base").alias("value_base"), F.lit("INR").alias("currency"),
        period.alias("period_key"), F.when(F.col("month").isNull(), "fy").otherwise("month").alias("granularity"), "fy", F.when(F.col("month").isNotNull(), fiscal_quarter(F.col("month"))).cast("int").alias("quarter"), "month",
        (F.col("fy") * 100 + F.when(F.col("month").isNotNull(), (F.col("month") + 8) % 12 + 1).otherwise(0)).alias("sort_key"),
        F.when(forward & (F.col("s.number") == 2), "forward").otherwise("actual").alias("basis_class"), "subject", F.lit("q").alias("quote"), of(_WEIGHT).alias("conf_value"), one.alias("conf_label"), one.alias("conf_period"), one.alias("conf_parse"),
        (F.col("s.number") * 1_000_000 + F.col("fy") * 100 + F.coalesce("month", F.ascii("subject"), F.lit(0))).cast("long").alias("ordinal"),
    )


def rates(spark) -> DataFrame:
    return spark.createDataFrame([], "session_id string, currency string, rate double")


OBS = f"""
l as (select l_orderkey, sum(cast(floor(l_extendedprice * 100 + 0.5) as bigint)) as gross, sum(cast(floor(l_extendedprice * l_discount * 100 + 0.5) as bigint)) as less,
  sum(cast(floor(l_extendedprice * (1 - l_discount) * (1 + l_tax) * 100 + 0.5) as bigint)) as net, sum(cast(l_quantity as bigint)) as quantity, count(*) as lines from lineitem group by 1),
j as (select cast(c_nationkey as varchar) as session_id, cast(case when month(o_orderdate) >= 4 then year(o_orderdate) else year(o_orderdate) - 1 end as integer) as fy, cast(month(o_orderdate) as integer) as month,
  cast(floor(o_totalprice * 100 + 0.5) as bigint) as total, o_custkey, lower(o_orderpriority) as priority, gross, less, net, quantity, lines from orders join l on l_orderkey = o_orderkey join customer on o_custkey = c_custkey),
y as (select session_id, fy, cast(null as integer) as month, cast(sum(total) as double) as total, cast(sum(gross) as double) as gross, cast(sum(quantity) as double) as quantity, cast(sum(lines) as double) as lines, cast(count(distinct o_custkey) as double) as people from j group by 1, 2),
m as (select session_id, fy, month, cast(sum(gross) as double) as gross, cast(sum(less) as double) as less, cast(sum(net) as double) as net from j group by 1, 2, 3),
h as (select session_id, fy, priority, count(*) as n, sum(count(*)) over (partition by session_id, fy) as total from j group by 1, 2, 3),
e as (
  select session_id, 'fs' as doc, 'revenue' as metric, gross / 100 as value, fy, month, null as subject, 1 as number from y
  union all select session_id, 'deck', 'revenue', case when fy >= {AHEAD} then total * 3 else total end / 100, fy, month, null, 2 from y
  union all select session_id, 'deck', 'customer_base', people, fy, month, null, 3 from y
  union all select session_id, 'mis', 'headcount', lines, fy, month, null, 4 from y
  union all select session_id, 'mis', 'ltv_cac_ratio', quantity / lines, fy, month, null, 5 from y
  union all select session_id, 'mis', 'revenue', gross / 100, fy, month, null, 6 from m
  union all select session_id, 'mis', 'cogs', less / 100, fy, month, null, 7 from m
  union all select session_id, 'mis', 'gross_profit', net / 100, fy, month, null, 8 from m
  union all select session_id, 'cap', 'ownership', floor(n * 1000 / cast(total as double) + 0.5) / 10, fy, null, priority, 9 from h),
obs as (select session_id, doc, metric, cast(value as double) as value, fy, month, coalesce(subject, '-') as subject, case when month is null then 'fy' else 'month' end as granularity,
  case when month is null then '' else 'M' || lpad(cast(month as varchar), 2, '0') || '-' end || 'FY' || cast(fy as varchar) || '-' || lpad(cast((fy + 1) % 100 as varchar), 2, '0') as period,
  case when fy >= {AHEAD} and number = 2 then 'forward' else 'actual' end as basis, case doc when 'mis' then 0.8::double when 'deck' then 0.9::double else 1.0::double end as weight,
  number * 1000000 + fy * 100 + coalesce(month, ascii(subject), 0) as ordinal from e),
w as (select *, sum(weight) over (partition by session_id, metric, period, basis, subject order by value, ordinal rows unbounded preceding) as run,
  sum(weight) over (partition by session_id, metric, period, basis, subject) as whole from obs),
n as (select session_id, metric, period, basis, subject, any_value(granularity) as granularity, any_value(fy) as fy, any_value(month) as month, min(value) as low, max(value) as high, count(distinct doc) as docs,
  min(case when run >= whole / 2 then value end) as consensus, min(weight) as conf, min(ordinal) as ordinal, count(*) as k from w group by 1, 2, 3, 4, 5)
"""
_TOLERANCE = "case metric when 'revenue' then 2.0 when 'cogs' then 2.0 when 'gross_profit' then 2.0 when 'customer_base' then 1.0 when 'headcount' then 8.0 when 'ownership' then 0.1 else 2.0 end"


def _r(c: Column | str, places: int = 4) -> Column:
    return rounded(F.col(c) if isinstance(c, str) else c, places)


def _s(expr: str, places: int = 4) -> str:
    return f"floor(({expr}) * {10**places} + 0.5) / {10**places}"


def nodes(spark, d: str) -> DataFrame:
    return facts.nodes(observations(spark, d), rates(spark))


def star_nodes(spark, d):
    """Every fact: consensus by weighted median, range, spread, documents, outliers, confidence."""
    return nodes(spark, d).select(
        "session_id", "metric_key", "period_key", "basis_class", "subject", _r("consensus").alias("consensus"), _r("low").alias("low"), _r("high").alias("high"), _r("spread_pct").alias("spread_pct"), "docs",
        F.col("n_outliers").alias("outliers"), _r("confidence").alias("confidence"),
    )


STAR_NODES = f"""
with {OBS}, f as (select w.session_id, w.metric, w.period, w.basis, w.subject, count(*) as outliers from w join n using (session_id, metric, period, basis, subject)
  where k > 1 and abs(value - consensus) / abs(consensus) * 100 > {_TOLERANCE.replace('metric', 'w.metric')} and w.metric <> 'ownership' group by all)
select session_id, metric as metric_key, period as period_key, basis as basis_class, subject, {_s('consensus')} as consensus, {_s('low')} as low, {_s('high')} as high,
  {_s('case when consensus = 0 then 0 else (high - low) / abs(consensus) * 100 end')} as spread_pct, docs, coalesce(outliers, 0) as outliers, {_s('conf')} as confidence
from n left join f using (session_id, metric, period, basis, subject)
"""


def scale_anchor(spark, d):
    return facts.scale_anchor(nodes(spark, d)).select("session_id", _r("anchor", 2).alias("anchor"))


SCALE_ANCHOR = f"with {OBS} select session_id, {_s('max(abs(consensus))', 2)} as anchor from n where metric = 'revenue' and basis = 'actual' group by 1"


def graph_stats(spark, d):
    return facts.graph_stats(nodes(spark, d)).select("session_id", F.col("observations").cast("long").alias("observations"), "nodes", "multi_source", "blocked")


GRAPH_STATS = f"with {OBS} select session_id, cast(sum(k) as bigint) as observations, count(*) as nodes, count(*) filter (docs >= 2) as multi_source, cast(0 as bigint) as blocked from n group by 1"


def unique_nodes(spark, d):
    """Facts that are alone for their metric, period and basis: those of one holder only among ownership."""
    return facts.unique_nodes(nodes(spark, d)).groupBy("session_id", "metric_key", "basis_class").agg(F.count(F.lit(1)).alias("n"))


UNIQUE_NODES = f"""
with {OBS}, a as (select *, count(*) over (partition by session_id, metric, period, basis) as same from n)
select session_id, metric as metric_key, basis as basis_class, count(*) as n from a where same = 1 group by all
"""


def rule_cross_source(spark, d):
    r = rules.cross_source(nodes(spark, d), RulePack())
    return r.select("session_id", "rule_id", "period_key", _r("stated").alias("stated"), _r("computed").alias("computed"), _r("delta_pct").alias("delta_pct"), "tolerance_pct", "result", "dissenting")


RULE_CROSS_SOURCE = f"""
with {OBS}, f as (select w.session_id, w.metric, w.period, w.basis, count(distinct doc) as dissenting from w join n using (session_id, metric, period, basis, subject)
  where abs(value - consensus) / abs(consensus) * 100 > {_TOLERANCE.replace('metric', 'w.metric')} group by all)
select session_id, 'R1.cross_source.' || metric as rule_id, period as period_key, {_s('high')} as stated, {_s('low')} as computed, {_s('(high - low) / abs(consensus) * 100')} as delta_pct,
  cast({_TOLERANCE} as double) as tolerance_pct, case when (high - low) / abs(consensus) * 100 > {_TOLERANCE} then 'FAIL' else 'PASS' end as result, coalesce(dissenting, 0) as dissenting
from n left join f using (session_id, metric, period, basis) where docs >= 2
"""


def rule_identities(spark, d):
    r = rules.identities(nodes(spark, d), RulePack())
    return r.select("session_id", "rule_id", "period_key", "document_id", _r("stated").alias("stated"), _r("computed").alias("computed"), _r("delta_pct").alias("delta_pct"), "result", F.col("detail").alias("culprit"), _r(F.col("figures")["culprit_needs"]).alias("culprit_needs"))


_GP = """p as (select a.session_id, a.period, a.consensus as r, b.consensus as c, g.consensus as g from n a join n b on a.session_id = b.session_id and a.period = b.period and a.basis = b.basis and b.metric = 'cogs'
  join n g on a.session_id = g.session_id and a.period = g.period and a.basis = g.basis and g.metric = 'gross_profit' where a.metric = 'revenue'),
q as (select *, g - (r - c) as gap, abs(g - (r - c)) / greatest(abs(g), abs(r - c)) * 100 as pct from p)"""
RULE_IDENTITIES = f"""
with {OBS}, {_GP}
select session_id, 'R2.gross_profit' as rule_id, period as period_key, 'mis' as document_id, {_s('g')} as stated, {_s('r - c')} as computed, {_s('pct')} as delta_pct, case when pct <= 0.5 then 'PASS' else 'FAIL' end as result,
  case when pct <= 0.5 then null when abs(gap / r) <= abs(gap / c) then 'revenue' else 'cogs' end as culprit, {_s("case when pct <= 0.5 then null when abs(gap / r) <= abs(gap / c) then r + gap else c - gap end")} as culprit_needs from q
"""


def rule_rollups(spark, d):
    r = rules.rollups(nodes(spark, d), RulePack())
    return r.select("session_id", "rule_id", "period_key", _r("stated", 2).alias("stated"), _r("computed", 2).alias("computed"), _r("delta_pct").alias("delta_pct"), "result", F.col("words")["culprit_period"].alias("culprit_period"))


RULE_ROLLUPS = f"""
with {OBS}, parts as (select session_id, fy, sum(consensus order by month) as computed, count(*) as k from n where metric = 'revenue' and granularity = 'month' group by 1, 2),
t as (select n.*, computed, abs(consensus - computed) / greatest(abs(consensus), abs(computed)) * 100 as pct from n join parts using (session_id, fy) where metric = 'revenue' and granularity = 'fy' and basis = 'actual' and parts.k = 12),
c as (select t.session_id, t.period, arg_min(m.period, (abs(abs(m.consensus) - abs(t.consensus - t.computed)), (m.month + 8) % 12)) as culprit from t join n m on m.session_id = t.session_id and m.fy = t.fy and m.metric = 'revenue' and m.granularity = 'month' where t.pct > 0.5 group by 1, 2)
select session_id, 'R3.month_to_fy' as rule_id, period as period_key, {_s('consensus', 2)} as stated, {_s('computed', 2)} as computed, {_s('pct')} as delta_pct, case when pct <= 0.5 then 'PASS' else 'FAIL' end as result, culprit as culprit_period
from t left join c using (session_id, period)
"""


def rule_temporal(spark, d):
    r = rules.temporal(nodes(spark, d), RulePack())
    return r.select("session_id", "rule_id", "period_key", _r("stated", 2).alias("implied"), _r("computed", 2).alias("trailing"), "result", "detail")


RULE_TEMPORAL = f"""
with {OBS}, a as (select session_id, metric, max(fy) as last_fy, arg_max(consensus, fy) as last, min(fy) as first_fy, arg_min(consensus, fy) as first from n where granularity = 'fy' and basis = 'actual' and metric in ('revenue', 'customer_base') group by 1, 2),
p as (select n.session_id, n.metric, min(n.fy) as next_fy, arg_min(n.consensus, n.fy) as next, arg_min(n.period, n.fy) as period from n join a using (session_id, metric) where n.granularity = 'fy' and n.basis = 'forward' and n.fy > last_fy group by 1, 2),
g as (select session_id, metric, period, case when last >= 100000 and next > 0 then (pow(next / last, 1.0 / (next_fy - last_fy)) - 1) * 100 end as implied,
  case when last_fy > first_fy and first >= 100000 then (pow(last / first, 1.0 / (last_fy - first_fy)) - 1) * 100 end as "trailing" from a join p using (session_id, metric))
select session_id, 'R4.growth.' || metric as rule_id, period as period_key, {_s('implied', 2)} as implied, {_s('"trailing"', 2)} as "trailing", 'FLAGGED' as result,
  case when "trailing" is null then 'no_trend' when "trailing" <= 0 then 'reversal_from_decline_to_growth' else 'growth_break' end as detail from g
where implied > 0 and case when "trailing" is null then implied >= 100 when "trailing" <= 0 then implied >= 50 else implied / "trailing" > 3 and implied >= 50 end
"""


def earlier(spark, d: str) -> DataFrame:
    """The observations with fs, mis and cap only before the first projection, so that growth has a seam."""
    return observations(spark, d).where((F.col("basis_class") == "forward") | (F.col("fy") < AHEAD))


def rule_growth_seam(spark, d):
    """R4 where actual years end before the first projection."""
    r = rules.temporal(facts.nodes(earlier(spark, d), rates(spark)), RulePack())
    return r.select("session_id", "rule_id", "period_key", _r("stated", 2).alias("implied"), _r("computed", 2).alias("trailing"), "result", "detail")


RULE_GROWTH_SEAM = RULE_TEMPORAL.replace("from e),", f"from e where (fy >= {AHEAD} and number = 2) or fy < {AHEAD}),")


def rule_coverage(spark, d):
    r = rules.unsupported(nodes(spark, d), RulePack())
    return r.select("session_id", "rule_id", "metric_key", "period_key", _r("stated").alias("stated"), "result", F.col("words")["searched"].alias("searched"))


RULE_COVERAGE = f"""
with {OBS}, dk as (select session_id, metric, period, basis, subject from obs group by all having bool_and(doc = 'deck')),
s as (select session_id, string_agg(distinct doc, ', ' order by doc) as searched from obs where doc <> 'deck' group by 1)
select session_id, 'R5.unsupported' as rule_id, metric as metric_key, period as period_key, {_s('consensus')} as stated, 'UNSUPPORTED' as result, searched from n join dk using (session_id, metric, period, basis, subject) join s using (session_id)
"""


def rule_plausibility(spark, d):
    r = rules.plausible(nodes(spark, d), RulePack())
    return r.select("session_id", "rule_id", "metric_key", "period_key", _r("stated", 3).alias("stated"), "computed", _r("delta_pct", 3).alias("delta_pct"), F.col("detail").alias("side"))


RULE_PLAUSIBILITY = f"""
with {OBS}, b as (select session_id, 'R6.band.ltv_cac_ratio' as rule_id, metric, period, consensus as v, 0.0 as least_, 20.0 as most_ from n where metric = 'ltv_cac_ratio'
  union all select a.session_id, 'R6.derived.revenue_per_employee', 'revenue_per_employee', a.period, a.consensus / b.consensus, 1e5, 1e8 from n a join n b on a.session_id = b.session_id and a.period = b.period and a.basis = b.basis and b.metric = 'headcount' where a.metric = 'revenue'),
c as (select *, case when v > most_ then most_ when v < least_ then least_ end as bound from b)
select session_id, rule_id, metric as metric_key, period as period_key, {_s('v', 3)} as stated, cast(bound as double) as computed, {_s('abs(v - bound) / greatest(abs(v), abs(bound)) * 100', 3)} as delta_pct, case when v > most_ then 'max' else 'min' end as side from c where bound is not null
"""


def rule_cap_table(spark, d):
    r = rules.cap_table(nodes(spark, d), RulePack())
    return r.select("session_id", "rule_id", "period_key", _r("stated").alias("total"), _r("delta_abs").alias("gap"), "result", F.col("figures")["holders"].cast("long").alias("holders"))


RULE_CAP_TABLE = f"""
with {OBS}, t as (select session_id, period, sum(consensus order by ordinal) as total, count(*) as holders from n where metric = 'ownership' group by 1, 2 having count(*) >= 2)
select session_id, case when total - 100 < -15 then 'R7.incomplete' else 'R7.ownership_sum' end as rule_id, period as period_key, {_s('total')} as total, {_s('total - 100')} as gap,
  case when total - 100 < -15 then 'BLOCKED' when abs(floor((total - 100) * 1e9 + 0.5) / 1e9) <= 0.1 then 'PASS' else 'FAIL' end as result, holders from t
"""


def _checked(spark, d: str, **more) -> tuple[DataFrame, DataFrame]:
    return findings.verify(observations(spark, d), rates(spark), rules=(rules.cross_source,), **more)


def severity_factors(spark, d):
    """The factors of each cross-source finding, its severity, band, class and code."""
    _, f = _checked(spark, d)
    return f.select("session_id", "metric_key", "period_key", _r("materiality", 6).alias("materiality"), _r("confidence", 6).alias("confidence"), "direction", "corroboration", "severity", "severity_band", "classification", "classification_reason", "pillar", "ref_code")


#: Cross-source findings f: n with two documents, factors, class, severity and rank.
_FOUND = f"""
an as (select session_id, max(abs(consensus)) as anchor from n where metric = 'revenue' and basis = 'actual' group by 1),
dv as (select w.session_id, w.metric, w.period, w.basis, count(distinct doc) as dissenting, max(case when doc = 'deck' then value end) as deck, max(case when doc = 'fs' then value end) as fs from w group by all),
ou as (select w.session_id, w.metric, w.period, w.basis, count(distinct doc) as out from w join n using (session_id, metric, period, basis, subject) where abs(value - consensus) / abs(consensus) * 100 > {_TOLERANCE.replace('metric', 'w.metric')} group by all),
f0 as (select n.*, anchor, high - low as delta_abs, (high - low) / abs(consensus) * 100 as delta_pct, {_TOLERANCE.replace('metric', 'n.metric')} as tol, deck, fs, coalesce(out, 0) as out
  from n join an using (session_id) join dv using (session_id, metric, period, basis) left join ou using (session_id, metric, period, basis) where docs >= 2),
f1 as (select *, least(log10(1 + delta_pct / tol) / log10(41.0), 1.0) as rel, least(delta_abs / (0.05 * anchor), 1.0) as part,
  case when deck is null or fs is null or deck = fs then 1.0 when deck > fs then 1.25 else 0.85 end as direction, case when out = 0 then 1.0 when out / cast(docs as double) <= 0.34 then 0.8 else 1.15 end as corroboration from f0),
f2 as (select *, least(greatest(0.4 + 1.6 * (case when delta_abs > 0 then 0.6 * rel + 0.4 * part else rel end) * 1.0, 0.4), 2.0) as materiality from f1),
f3 as (select *, greatest(least(15.0 * materiality * conf * direction * corroboration, 100), 0) as raw,
  case when floor(delta_pct * 1e9 + 0.5) / 1e9 <= tol then 'VERIFIED_CONSISTENT' when conf < 0.65 then 'UNRESOLVED_INCONSISTENCY' when floor(delta_pct * 1e9 + 0.5) / 1e9 <= tol * 2 then 'UNRESOLVED_INCONSISTENCY' else 'VERIFIED_MISMATCH' end as class,
  case when floor(delta_pct * 1e9 + 0.5) / 1e9 <= tol then 'within_tolerance' when conf < 0.65 then 'below_confidence_gate' when floor(delta_pct * 1e9 + 0.5) / 1e9 <= tol * 2 then 'marginal_variance' else 'material_variance' end as reason from f2),
f4 as (select *, case when class = 'VERIFIED_CONSISTENT' then 0.0 else floor(raw * 10 + 0.5) / 10 end as severity,
  case when class = 'VERIFIED_CONSISTENT' then 'NONE' when raw >= 30 then 'CRITICAL' when raw >= 18 then 'HIGH' when raw >= 9 then 'MEDIUM' else 'MINOR' end as band from f3),
f as (select *, 'REV-R1-' || lpad(cast(row_number() over (partition by session_id order by severity desc, ordinal) as varchar), 3, '0') as ref_code from f4)
"""
SEVERITY_FACTORS = f"""
with {OBS}, {_FOUND}
select session_id, metric as metric_key, period as period_key, {_s('materiality', 6)} as materiality, {_s('conf', 6)} as confidence, cast(direction as double) as direction, cast(corroboration as double) as corroboration, severity,
  band as severity_band, class as classification, reason as classification_reason, 'cross_doc_consistency' as pillar, ref_code from f
"""


def pillar_scores(spark, d):
    n, f = _checked(spark, d)
    return findings.pillars(n, f).select("session_id", "pillar", "weight", _r("severity", 1).alias("severity"), "problems", "applicable", "pillar_score")


_PILLARS = """
s as (select session_id, floor(sum(severity) * 10 + 0.5) / 10 as severity, count(*) filter (class <> 'VERIFIED_CONSISTENT') as problems from f group by 1),
p as (select i.session_id, v.pillar, v.weight, case when v.pillar = 'cross_doc_consistency' then coalesce(severity, 0) else 0 end as severity, case when v.pillar = 'cross_doc_consistency' then coalesce(problems, 0) else 0 end as problems
  from (select distinct session_id from n) i cross join (values ('arithmetic_integrity', 0.25::double), ('cross_doc_consistency', 0.30::double), ('evidence_coverage', 0.20::double), ('projection_credibility', 0.15::double), ('ownership_integrity', 0.10::double)) v(pillar, weight) left join s using (session_id)),
ps as (select *, floor(100 * 40.0 / (40 + severity) * 10 + 0.5) / 10 as pillar_score from p)
"""
PILLAR_SCORES = f"with {OBS}, {_FOUND}, {_PILLARS} select session_id, pillar, weight, cast(severity as double) as severity, cast(problems as bigint) as problems, true as applicable, pillar_score from ps"


def readiness_score(spark, d):
    return findings.readiness(*_checked(spark, d)).select("session_id", "ceiling", F.col("score").cast("long").alias("score"), "band")


READINESS_SCORE = f"""
with {OBS}, {_FOUND}, {_PILLARS}, b as (select session_id, sum(pillar_score * weight) as base from ps group by 1),
c as (select session_id, floor((55 + 45 * (0.6 * (count(*) filter (docs >= 2) / cast(count(*) as double)) + 0.4 * 0.8)) * 10 + 0.5) / 10 as ceiling from n group by 1),
r as (select session_id, ceiling, cast(floor(least(base, ceiling) + 0.5) as bigint) as score from b join c using (session_id))
select *, case when score >= 85 then 'READY' when score >= 70 then 'CONDITIONAL' when score >= 50 then 'MATERIAL_GAPS' else 'HIGH_RISK' end as band from r
"""


def class_counts(spark, d):
    return findings.class_counts(_checked(spark, d)[1])


CLASS_COUNTS = f"""
with {OBS}, {_FOUND} select session_id, cast(0 as bigint) as unsupported_claims, count(*) filter (class = 'VERIFIED_MISMATCH') as verified_mismatch, count(*) filter (class = 'UNRESOLVED_INCONSISTENCY') as unresolved_inconsistency,
  cast(0 as bigint) as missing_information, cast(0 as bigint) as unusual_assumption_change, count(*) filter (class = 'VERIFIED_CONSISTENT') as verified_consistent, count(*) as total from f group by 1
"""


def top_findings_per_pillar(spark, d):
    """The three most severe problems of each pillar: a report's feature."""
    return findings.top_by_pillar(_checked(spark, d)[1]).select("session_id", "pillar", F.col("rank").cast("long").alias("rank"), "ref_code", "severity")


TOP_FINDINGS_PER_PILLAR = f"""
with {OBS}, {_FOUND}, r as (select *, row_number() over (partition by session_id order by severity desc, ref_code) as rank from f where class <> 'VERIFIED_CONSISTENT')
select session_id, 'cross_doc_consistency' as pillar, rank, ref_code, severity from r where rank <= 3
"""


def adjudicate_tolerance(spark, d):
    """Classes once revenue may differ by 40 %."""
    out = adjudicate.adjudicate(observations(spark, d), rates(spark), [adjudicate.Override("tolerance", metric_key="revenue", tolerance_pct=40.0)], rules=(rules.cross_source,))
    return out.findings.groupBy("session_id", "classification").agg(F.count(F.lit(1)).alias("n"))


ADJUDICATE_TOLERANCE = f"with {OBS}, {_FOUND} select session_id, case when floor(delta_pct * 1e9 + 0.5) / 1e9 <= 40 then 'VERIFIED_CONSISTENT' when floor(delta_pct * 1e9 + 0.5) / 1e9 <= 80 then 'UNRESOLVED_INCONSISTENCY' else 'VERIFIED_MISMATCH' end as classification, count(*) as n from f group by 1, 2"


def adjudicate_authoritative(spark, d):
    """Confidence of each finding once the statements count as certain, and the deck's half."""
    got = adjudicate.authoritative(observations(spark, d), "fs")
    return got.groupBy("session_id", "document_id", _r("conf_value", 2).alias("conf_value")).agg(F.count(F.lit(1)).alias("n"))


ADJUDICATE_AUTHORITATIVE = f"""
with {OBS}, c as (select distinct session_id, metric, period, basis, subject, true as covered from obs where doc = 'fs')
select session_id, doc as document_id, {_s("case when doc = 'fs' then 1.0 when covered then weight * 0.5 else weight end", 2)} as conf_value, count(*) as n from obs left join c using (session_id, metric, period, basis, subject) group by all
"""


def adjudicate_accept(spark, d):
    """Scores once each session's worst mismatch is accepted, against those before."""
    obs, none = observations(spark, d), rates(spark)
    n, f = _checked(spark, d)
    refs = f.select("session_id").distinct().select("session_id", F.lit("REV-R1-001").alias("ref_code"), F.lit("explained").alias("note"))
    after = adjudicate.accepted(f, refs)
    moved = adjudicate.pillar_diff(findings.pillars(n, f), findings.pillars(n, after.where("not accepted")))
    return moved.where("changed").select("session_id", "pillar", "before", "after", "change")


ADJUDICATE_ACCEPT = f"""
with {OBS}, {_FOUND}, b as (select session_id, floor(sum(severity) * 10 + 0.5) / 10 as s, floor(sum(case when ref_code <> 'REV-R1-001' then severity else 0 end) * 10 + 0.5) / 10 as t from f group by 1),
c as (select session_id, floor(100 * 40.0 / (40 + s) * 10 + 0.5) / 10 as before, floor(100 * 40.0 / (40 + t) * 10 + 0.5) / 10 as after from b)
select session_id, 'cross_doc_consistency' as pillar, before, after, floor((after - before) * 10 + 0.5) / 10 as change from c where abs(floor((after - before) * 10 + 0.5) / 10) >= 0.1
"""


def adjudicate_diff(spark, d):
    """What a tolerance of 40 % changes, finding by finding."""
    obs, none = observations(spark, d), rates(spark)
    before = _checked(spark, d)[1]
    after = adjudicate.adjudicate(obs, none, [adjudicate.Override("tolerance", metric_key="revenue", tolerance_pct=40.0)], rules=(rules.cross_source,)).findings
    return adjudicate.diff(before, after).groupBy("session_id", "change", "before_class", "after_class").agg(F.count(F.lit(1)).alias("n"))


ADJUDICATE_DIFF = f"""
with {OBS}, {_FOUND}, -- with another tolerance, other documents may be outliers too, and the factors follow
o2 as (select w.session_id, w.metric, w.period, w.basis, count(distinct doc) as out2 from w join n using (session_id, metric, period, basis, subject) where abs(value - consensus) / abs(consensus) * 100 > 40 group by all),
g2 as (select f.*, case when coalesce(out2, 0) = 0 then 1.0 when out2 / cast(docs as double) <= 0.34 then 0.8 else 1.15 end as corroboration2, least(log10(1 + delta_pct / 40.0) / log10(41.0), 1.0) as rel2 from f left join o2 using (session_id, metric, period, basis)),
h2 as (select *, greatest(least(15.0 * least(greatest(0.4 + 1.6 * (case when delta_abs > 0 then 0.6 * rel2 + 0.4 * part else rel2 end), 0.4), 2.0) * conf * direction * corroboration2, 100), 0) as raw2,
  case when floor(delta_pct * 1e9 + 0.5) / 1e9 <= 40 then 'VERIFIED_CONSISTENT' when conf < 0.65 then 'UNRESOLVED_INCONSISTENCY' when floor(delta_pct * 1e9 + 0.5) / 1e9 <= 80 then 'UNRESOLVED_INCONSISTENCY' else 'VERIFIED_MISMATCH' end as now from g2),
a as (select session_id, class, now, case when class <> now then 'reclassified' when severity <> case when now = 'VERIFIED_CONSISTENT' then 0.0 else floor(raw2 * 10 + 0.5) / 10 end then 'rescored' end as change from h2)
select session_id, change, class as before_class, now as after_class, count(*) as n from a where change is not null group by all
"""


def narratives(spark, d):
    """The narrative and question of each cross-source mismatch."""
    f = explain.explained(_checked(spark, d)[1]).where("classification = 'VERIFIED_MISMATCH'")
    return f.select("session_id", "ref_code", "narrative", "follow_up_question")


def _grouped_sql(v: str) -> str:
    """Indian groups without lookahead: the last three digits, then pairs."""
    whole = f"cast(cast(floor(abs({v}) + 0.5) as bigint) as varchar)"
    pairs = f"reverse(regexp_replace(reverse(left({whole}, length({whole}) - 3)), '(\\d\\d)', '\\1,', 'g'))"
    return f"'Rs ' || case when length({whole}) <= 3 then {whole} else ltrim({pairs}, ',') || ',' || right({whole}, 3) end"


def _pct_sql(v: str) -> str:
    return f"regexp_replace(regexp_replace(printf('%.2f', floor({v} * 100 + 0.5) / 100), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') || '%'"


NARRATIVES = f"""
with {OBS}, {_FOUND}, t as (select *, case when deck > fs or (deck = fs) then 'deck' else 'fs' end as top, case when deck > fs or (deck = fs) then 'fs' else 'deck' end as bottom from f where class = 'VERIFIED_MISMATCH')
select session_id, ref_code, 'Documents differ (Revenue, ' || period || '). highest: ' || top || ' ' || {_grouped_sql('high')} || '; lowest: ' || bottom || ' ' || {_grouped_sql('low')} || '; gap: ' || {_pct_sql('delta_pct')} || '; tolerance: 2%'
    || case when direction > 1 then '; lean: the less authoritative figure flatters' else '' end || '.' as narrative,
  'Revenue, ' || period || ': Say which figure holds, and why the other one departs from it. (highest ' || top || ' ' || {_grouped_sql('high')} || ', lowest ' || bottom || ' ' || {_grouped_sql('low')} || ')' as follow_up_question
from t
"""


def report_questions(spark, d):
    """Each session's questions in order of severity: at most twelve, a report's length."""
    q = explain.questions(explain.explained(_checked(spark, d)[1]))
    return q.select("session_id", F.col("priority").cast("long").alias("priority"), "ref_code", "severity")


REPORT_QUESTIONS = f"""
with {OBS}, {_FOUND}, r as (select *, row_number() over (partition by session_id order by severity desc, ref_code) as priority from f where class <> 'VERIFIED_CONSISTENT')
select session_id, priority, ref_code, severity from r where priority <= 12
"""


def figure_matrix(spark, d):
    """Revenue and customers by year: the last value of each kind of document."""
    m = serving.comparison_matrix(observations(spark, d).where("granularity = 'fy'"), list(_CATEGORY.values()))
    return m.select("session_id", "metric_key", "period_key", *[_r(c).alias(c) for c in _CATEGORY.values()], "source_count")


FIGURE_MATRIX = f"""
with {OBS} select session_id, case when subject = '-' then metric else metric || ' (' || subject || ')' end as metric_key, period as period_key, {_s("arg_max(value, ordinal) filter (doc = 'mis')")} as mis,
  {_s("arg_max(value, ordinal) filter (doc = 'fs')")} as financial_statements, {_s("arg_max(value, ordinal) filter (doc = 'deck')")} as pitch_deck, {_s("arg_max(value, ordinal) filter (doc = 'cap')")} as cap_table, count(distinct doc) as source_count
from obs where granularity = 'fy' group by all
"""


def earlier_matrix(spark, d):
    m = observations(spark, d).where("granularity = 'fy' and subject is null").select("session_id", "metric_key", "period_key", "document_category", F.col("value_base").alias("value"), "currency", "ordinal")
    return serving.legacy_matrix(m)


EARLIER_MATRIX = f"""
with {OBS}, g as (select session_id, metric, period, count(distinct doc) as categories, min(value) as low, max(value) as high from obs where granularity = 'fy' and subject = '-' group by all),
v as (select *, case when categories > 1 and low <> 0 then (high - low) / abs(low) * 100 else 0 end as pct from g)
select session_id, metric as metric_key, period as period_key, categories, {_s('pct')} as variance_pct,
  case when categories = 1 then 'PARTIAL_COVERAGE' when pct <= 1 then 'VERIFIED_CONSISTENT' when pct <= 2 then 'UNRESOLVED_INCONSISTENCY' else 'VERIFIED_MISMATCH' end as status from v
"""


def earlier_claims(spark, d):
    m = observations(spark, d).where("granularity = 'fy' and subject is null").select("session_id", "metric_key", "period_key", "document_category", F.col("value_base").alias("value"), "ordinal")
    return serving.legacy_claims(m).select("session_id", "ref_code", "metric_key", "period_key", "value", "classification")


EARLIER_CLAIMS = f"""
with {OBS}, c as (select * from obs a where granularity = 'fy' and subject = '-' and doc = 'deck' and not exists (select 1 from obs b where b.session_id = a.session_id and b.metric = a.metric and b.period = a.period and b.doc <> 'deck' and b.subject = '-'))
select session_id, 'MISSING-CLAIM-' || lpad(cast(row_number() over (partition by session_id order by ordinal) as varchar), 3, '0') as ref_code, metric as metric_key, period as period_key, value, 'MISSING_INFORMATION' as classification from c
"""

def audit(spark, d):
    """All seven rules at once, over the observations with a seam, and what is left when rules speak of the same cell."""
    _, f = findings.verify(earlier(spark, d), rates(spark))
    return f.select("session_id", "rule_id", "metric_key", "period_key", "classification", "pillar")


def _seam(sql: str) -> str:
    return sql.replace("from e),", f"from e where (fy >= {AHEAD} and number = 2) or fy < {AHEAD}),")


def _graded(gap: str, tolerance: str) -> str:
    return f"case when {gap} <= {tolerance} then 'VERIFIED_CONSISTENT' when {gap} <= {tolerance} * 2 then 'UNRESOLVED_INCONSISTENCY' else 'VERIFIED_MISMATCH' end"


def halfway_prices(spark, d):
    """Each supplier's price at half of its quantity, by the selection over ranges that hot nodes take."""
    x = spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", "l_extendedprice", F.col("l_quantity").cast("long").alias("w"))
    return facts.halfway(x, ["l_suppkey"], "l_extendedprice", "w").withColumnRenamed("half", "median")


HALFWAY_PRICES = """
with r as (select l_suppkey, l_extendedprice, sum(l_quantity) over (partition by l_suppkey order by l_extendedprice) as run, sum(l_quantity) over (partition by l_suppkey) as total from lineitem)
select l_suppkey, min(l_extendedprice) as median from r where run >= total / 2 group by l_suppkey
"""


def finding_evidence(spark, d):
    """How many observations the findings of each rule rest on: joined by node and document."""
    obs, none = earlier(spark, d), rates(spark)
    _, f = findings.verify(obs, none, rules=(rules.cross_source, rules.unsupported, rules.cap_table))
    e = findings.evidence(f, obs, none)
    return e.groupBy("session_id", F.substring("ref_code", 1, 3).alias("of"), "filename").agg(F.count(F.lit(1)).alias("n"))


FINDING_EVIDENCE = f"""
with {_seam(OBS)}, k as (select *, count(*) over (partition by session_id, period) as holders from n where metric = 'ownership'),
dk as (select session_id, metric, period, basis, subject from obs group by all having bool_and(doc = 'deck')),
pr as (select distinct session_id, period from n where docs >= 2),
q as (select n.*, (high - low) / abs(consensus) * 100 as pct from n where docs >= 2),
u as (select o.session_id, 'REV' as of, o.doc from obs o join q using (session_id, metric, period, basis, subject)
  union all select o.session_id, case o.metric when 'revenue' then 'REV' when 'customer_base' then 'CUS' end, o.doc from obs o join dk using (session_id, metric, period, basis, subject)
  union all select o.session_id, 'OWN', o.doc from obs o join k using (session_id, metric, period, basis, subject) where k.holders >= 2)
select session_id, of, doc as filename, count(*) as n from u group by all
"""

def session_tolerances(spark, d):
    """Cross-source findings where most sessions have a tolerance of their own, and the others a common one."""
    nation = spark.read.parquet(f"{d}/nation.parquet")
    own = nation.where("n_nationkey % 4 <> 0").selectExpr("cast(n_nationkey as string) as session_id", "'tolerance' as item", "'revenue' as key", "cast((n_nationkey % 5 + 1) * 10 as double) as value", "1L as version")
    common = spark.createDataFrame([(None, "tolerance", "revenue", 2.0, 1), (None, "tolerance", "revenue", 60.0, 2)], SETTING)
    _, f = findings.verify(observations(spark, d), rates(spark), RulePack().with_settings(own.unionByName(common)), rules=(rules.cross_source,))
    return f.select("session_id", "period_key", F.col("tolerance_pct").alias("tolerance"), _r("delta_pct").alias("delta_pct"), "classification", "dissenting")


SESSION_TOLERANCES = f"""
with {OBS}, t as (select cast(n_nationkey as varchar) as session_id, cast(case when n_nationkey % 4 = 0 then 60 else (n_nationkey % 5 + 1) * 10 end as double) as tolerance from nation),
q as (select n.*, tolerance, (high - low) / abs(consensus) * 100 as pct from n join t using (session_id) where docs >= 2),
o as (select w.session_id, w.period, w.basis, count(distinct doc) as dissenting from w join q using (session_id, metric, period, basis, subject) where abs(value - q.consensus) / abs(q.consensus) * 100 > tolerance group by all)
select session_id, period as period_key, tolerance, {_s('pct')} as delta_pct, {_graded('floor(pct * 1e9 + 0.5) / 1e9', 'tolerance')} as classification, coalesce(dissenting, 0) as dissenting from q left join o using (session_id, period, basis)
"""


def refreshed(spark, d):
    """Findings after the statements of one region were replaced by doubled ones: only its sessions are checked again."""
    ledger, none, checks = Ledger.at(spark, shared(spark), buckets=16), rates(spark), (rules.cross_source,)
    obs = once(observations(spark, d))
    ledger.observations.append(obs)
    refresh(ledger, none, rules=checks)
    region = spark.read.parquet(f"{d}/nation.parquet").where("n_regionkey = 2").select(F.col("n_nationkey").cast("string").alias("session_id"))
    value = F.when(F.col("document_id") == "fs", F.col("value_base") * 2).otherwise(F.col("value_base"))
    ledger.observations.replace(obs.join(region, "session_id", "left_semi").withColumn("value_base", value))
    done = refresh(ledger, none, rules=checks)
    f = ledger.findings.read().join(done, "session_id")
    return f.groupBy("session_id", "action", "classification").agg(F.count(F.lit(1)).alias("n"), _r(F.sum("severity"), 1).alias("severity"))


_REGION = "(select cast(n_nationkey as varchar) from nation where n_regionkey = 2)"
_DOUBLED = OBS.replace("'revenue' as metric, gross / 100 as value", f"'revenue' as metric, gross / 100 * case when session_id in {_REGION} then 2 else 1 end as value")
REFRESHED = f"""
with {_DOUBLED}, {_FOUND} select session_id, case when session_id in {_REGION} then 'checked' else 'carried' end as action, class as classification, count(*) as n, {_s('sum(severity)', 1)} as severity from f group by all
"""

AUDIT = f"""
with f as (
  select session_id, rule_id, 'revenue' as metric_key, period_key, {_graded('delta_pct', 'tolerance_pct')} as classification, 'cross_doc_consistency' as pillar from ({_seam(RULE_CROSS_SOURCE)})
  union all select session_id, rule_id, 'gross_profit', period_key, {_graded('delta_pct', '0.5')}, 'arithmetic_integrity' from ({_seam(RULE_IDENTITIES)})
  union all select session_id, rule_id, 'revenue', period_key, {_graded('delta_pct', '0.5')}, 'arithmetic_integrity' from ({_seam(RULE_ROLLUPS)})
  union all select session_id, rule_id, split_part(rule_id, '.', 3), period_key, 'UNUSUAL_ASSUMPTION_CHANGE', 'projection_credibility' from ({RULE_GROWTH_SEAM})
  union all select session_id, rule_id, metric_key, period_key, 'MISSING_INFORMATION', 'evidence_coverage' from ({_seam(RULE_COVERAGE)})
  union all select session_id, rule_id, metric_key, period_key, 'VERIFIED_MISMATCH', 'projection_credibility' from ({_seam(RULE_PLAUSIBILITY)})
  union all select session_id, rule_id, 'ownership', period_key, case when result = 'BLOCKED' then 'UNRESOLVED_INCONSISTENCY' else {_graded('abs(gap)', '0.1')} end, 'ownership_integrity' from ({_seam(RULE_CAP_TABLE)})
), g as (
  select *, bool_or(classification <> 'VERIFIED_CONSISTENT') over (partition by session_id, metric_key, period_key) as problem, bool_or(rule_id like 'R2.%') over (partition by session_id, metric_key, period_key) as stated from f
)
select session_id, rule_id, metric_key, period_key, classification, pillar from g where not (problem and classification = 'VERIFIED_CONSISTENT') and not (stated and rule_id like 'R6.derived%')
"""

QUERIES = {
    "star_nodes": star_nodes, "scale_anchor": scale_anchor, "graph_stats": graph_stats, "unique_nodes": unique_nodes, "rule_cross_source": rule_cross_source, "rule_identities": rule_identities, "rule_rollups": rule_rollups,
    "rule_temporal": rule_temporal, "rule_growth_seam": rule_growth_seam, "rule_coverage": rule_coverage, "rule_plausibility": rule_plausibility, "rule_cap_table": rule_cap_table, "severity_factors": severity_factors,
    "pillar_scores": pillar_scores, "readiness_score": readiness_score, "class_counts": class_counts, "top_findings_per_pillar": top_findings_per_pillar, "adjudicate_tolerance": adjudicate_tolerance,
    "adjudicate_authoritative": adjudicate_authoritative, "adjudicate_accept": adjudicate_accept, "adjudicate_diff": adjudicate_diff, "narratives": narratives, "report_questions": report_questions,
    "figure_matrix": figure_matrix, "earlier_matrix": earlier_matrix, "earlier_claims": earlier_claims, "audit": audit, "halfway_prices": halfway_prices, "finding_evidence": finding_evidence,
    "session_tolerances": session_tolerances, "refreshed": refreshed,
}
ORACLES = {
    "star_nodes": STAR_NODES, "scale_anchor": SCALE_ANCHOR, "graph_stats": GRAPH_STATS, "unique_nodes": UNIQUE_NODES, "rule_cross_source": RULE_CROSS_SOURCE, "rule_identities": RULE_IDENTITIES, "rule_rollups": RULE_ROLLUPS,
    "rule_temporal": RULE_TEMPORAL, "rule_growth_seam": RULE_GROWTH_SEAM, "rule_coverage": RULE_COVERAGE, "rule_plausibility": RULE_PLAUSIBILITY, "rule_cap_table": RULE_CAP_TABLE, "severity_factors": SEVERITY_FACTORS,
    "pillar_scores": PILLAR_SCORES, "readiness_score": READINESS_SCORE, "class_counts": CLASS_COUNTS, "top_findings_per_pillar": TOP_FINDINGS_PER_PILLAR, "adjudicate_tolerance": ADJUDICATE_TOLERANCE,
    "adjudicate_authoritative": ADJUDICATE_AUTHORITATIVE, "adjudicate_accept": ADJUDICATE_ACCEPT, "adjudicate_diff": ADJUDICATE_DIFF, "narratives": NARRATIVES, "report_questions": REPORT_QUESTIONS,
    "figure_matrix": FIGURE_MATRIX, "earlier_matrix": EARLIER_MATRIX, "earlier_claims": EARLIER_CLAIMS, "audit": AUDIT, "halfway_prices": HALFWAY_PRICES, "finding_evidence": FINDING_EVIDENCE,
    "session_tolerances": SESSION_TOLERANCES, "refreshed": REFRESHED,
}

"""The operators over a star schema: order data as figures that documents report.

Each query has the same in DuckDB's SQL beside it. Sums of doubles are compared after rounding, as
their order differs between engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attest.functions.period import fiscal_quarter, fiscal_start, year_label
from attest.functions.text import currency_of, is_percent, numbered, rounded
from attest.operators.facts import nodes
from attest.operators.findings import verify
from attest.operators.rules import cross_source
from attest.plans.rulepack import RulePack


def _read(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{d}/{n}.parquet") for n in names]


def fiscal_period_keys(spark, d):
    (o,) = _read(spark, d, "orders")
    m, y = F.month("o_orderdate"), F.year("o_orderdate")
    fy = fiscal_start(m, y)
    return o.groupBy(fy.alias("fy"), m.alias("month"), fiscal_quarter(m).alias("quarter"), F.concat(F.format_string("M%02d-", m), year_label(fy)).alias("period_key")).agg(F.count(F.lit(1)).alias("n"))


_FY = "case when month(o_orderdate) >= 4 then year(o_orderdate) else year(o_orderdate) - 1 end"
_LABEL = "'FY' || cast(fy as varchar) || '-' || lpad(cast((fy + 1) % 100 as varchar), 2, '0')"

FISCAL_PERIOD_KEYS = f"""
with o as (select cast({_FY} as integer) as fy, cast(month(o_orderdate) as integer) as month from orders)
select fy, month, cast((((month + 8) % 12) // 3) + 1 as integer) as quarter,
  'M' || lpad(cast(month as varchar), 2, '0') || '-' || {_LABEL} as period_key, count(*) as n
from o group by fy, month
"""


def money_and_percent(spark, d):
    (x,) = _read(spark, d, "documents")
    return x.groupBy(F.coalesce(currency_of("text"), F.lit("none")).alias("currency"), is_percent(F.col("text")).alias("percent")).agg(F.count(F.lit(1)).alias("n"))


MONEY_AND_PERCENT = r"""
select case when contains(t, '₹') or contains(t, 'rs') or contains(t, 'inr') then 'INR' when contains(t, 'usd') or contains(t, 'us$') or contains(t, '$') then 'USD'
  when contains(t, 'eur') or contains(t, '€') then 'EUR' when contains(t, 'gbp') or contains(t, '£') then 'GBP' when contains(t, 'aed') then 'AED' when contains(t, 'sgd') then 'SGD' else 'none' end as currency,
  contains(t, '%') or regexp_matches(t, '\b(percent|pct)\b') as percent, count(*) as n
from (select lower(text) as t from documents) group by 1, 2
"""


def fact_nodes(spark, d):
    """Month facts of order value by priority: count, range and spread."""
    (o,) = _read(spark, d, "orders")
    g = o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("period_key"), F.col("o_orderpriority").alias("subject")).agg(
        F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.count_distinct("o_custkey").alias("sources")
    )
    return g.withColumn("spread_abs", rounded(F.col("high") - F.col("low"), 4))


FACT_NODES = """
select strftime(o_orderdate, '%Y-%m') as period_key, o_orderpriority as subject, count(*) as n, min(o_totalprice) as low, max(o_totalprice) as high,
  count(distinct o_custkey) as sources, floor((max(o_totalprice) - min(o_totalprice)) * 10000 + 0.5) / 10000 as spread_abs
from orders group by 1, 2
"""


def weighted_median(spark, d):
    """Quantity-weighted lower median price for each supplier; the windows spill, groups are no arrays."""
    (x,) = _read(spark, d, "lineitem")
    w = W.partitionBy("l_suppkey").orderBy("l_extendedprice", "l_orderkey", "l_linenumber").rowsBetween(W.unboundedPreceding, 0)
    r = x.withColumns({"run": F.sum("l_quantity").over(w), "total": F.sum("l_quantity").over(W.partitionBy("l_suppkey"))})
    return r.where(F.col("run") >= F.col("total") / 2).groupBy("l_suppkey").agg(F.min("l_extendedprice").alias("median"))


WEIGHTED_MEDIAN = """
with r as (select l_suppkey, l_extendedprice, sum(l_quantity) over (partition by l_suppkey order by l_extendedprice, l_orderkey, l_linenumber rows unbounded preceding) as run,
  sum(l_quantity) over (partition by l_suppkey) as total from lineitem)
select l_suppkey, min(l_extendedprice) as median from r where run >= total / 2 group by l_suppkey
"""


def _reported(spark, d):
    """Two documents for each order: the order's total and its lines' sum."""
    o, x = _read(spark, d, "orders", "lineitem")
    sums = x.groupBy("l_orderkey").agg(rounded(F.sum(F.col("l_extendedprice").cast("decimal(18,4)")).cast("double"), 2).alias("lines"))
    return o.join(sums, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_orderdate", F.col("o_totalprice").alias("stated"), "lines")


_REPORTED = """
r as (select o_orderkey, o_orderdate, o_totalprice as stated, floor(cast(lines as double) * 100 + 0.5) / 100 as lines from orders
  join (select l_orderkey, sum(cast(l_extendedprice as decimal(18,4))) as lines from lineitem group by l_orderkey) on o_orderkey = l_orderkey)
"""


def cross_source_conflict(spark, d):
    r = _reported(spark, d)
    gap = F.abs(F.col("stated") - F.col("lines")) / F.greatest(F.abs("stated"), F.abs("lines")) * 100
    r = r.withColumn("gap_pct", rounded(gap, 4))
    kind = F.when(F.col("gap_pct") <= 2, "VERIFIED_CONSISTENT").when(F.col("gap_pct") <= 4, "UNRESOLVED_INCONSISTENCY").otherwise("VERIFIED_MISMATCH")
    return r.select("o_orderkey", "gap_pct", kind.alias("classification"))


CROSS_SOURCE_CONFLICT = f"""
with {_REPORTED}, g as (select o_orderkey, floor(abs(stated - lines) / greatest(abs(stated), abs(lines)) * 100 * 10000 + 0.5) / 10000 as gap_pct from r)
select o_orderkey, gap_pct, case when gap_pct <= 2 then 'VERIFIED_CONSISTENT' when gap_pct <= 4 then 'UNRESOLVED_INCONSISTENCY' else 'VERIFIED_MISMATCH' end as classification from g
"""


def rollup_months_to_fy(spark, d):
    """Years of which all twelve months have orders: the months' sum against the year's."""
    (o,) = _read(spark, d, "orders")
    m = F.month("o_orderdate")
    o = o.select(fiscal_start(m, F.year("o_orderdate")).alias("fy"), m.alias("month"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    months = o.groupBy("fy", "month").agg(F.sum("v").alias("v"))
    return months.groupBy("fy").agg(F.count(F.lit(1)).alias("months"), F.sum("v").cast("double").alias("computed")).where("months = 12")


ROLLUP_MONTHS_TO_FY = f"""
with o as (select cast({_FY} as integer) as fy, month(o_orderdate) as month, cast(o_totalprice as decimal(18,2)) as v from orders),
m as (select fy, month, sum(v) as v from o group by fy, month)
select fy, count(*) as months, cast(sum(v) as double) as computed from m group by fy having count(*) = 12
"""


def growth_break(spark, d):
    """For each segment, order value of a year against the year before, flagged from 10 % on."""
    o, c = _read(spark, d, "orders", "customer")
    j = o.join(c.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    y = j.groupBy("c_mktsegment", F.year("o_orderdate").alias("year")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("v"))
    before = y.select("c_mktsegment", (F.col("year") + 1).alias("year"), F.col("v").alias("base"))
    g = y.join(before, ["c_mktsegment", "year"]).withColumn("growth_pct", rounded((F.col("v") / F.col("base") - 1) * 100, 4))
    return g.select("c_mktsegment", "year", "growth_pct", (F.abs("growth_pct") >= 10).alias("flagged"))


GROWTH_BREAK = """
with y as (select c_mktsegment, cast(year(o_orderdate) as integer) as year, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as v
  from orders join customer on o_custkey = c_custkey group by 1, 2),
g as (select a.c_mktsegment, a.year, floor((a.v / b.v - 1) * 100 * 10000 + 0.5) / 10000 as growth_pct from y a join y b on a.c_mktsegment = b.c_mktsegment and a.year = b.year + 1)
select c_mktsegment, year, growth_pct, abs(growth_pct) >= 10 as flagged from g
"""


def unsupported_claims(spark, d):
    o, x = _read(spark, d, "orders", "lineitem")
    return o.join(x.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey", F.col("o_totalprice").alias("stated"))


UNSUPPORTED_CLAIMS = "select o_orderkey, o_totalprice as stated from orders o where not exists (select 1 from lineitem where l_orderkey = o.o_orderkey)"


def plausibility_bands(spark, d):
    """Balances and prices outside their bands."""
    s, p = _read(spark, d, "supplier", "part")
    bands = F.broadcast(spark.createDataFrame([("balance", 0.0, 9000.0), ("price", 905.0, 1900.0)], "metric string, least double, most double"))
    v = s.select(F.lit("balance").alias("metric"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("value")).unionByName(p.select(F.lit("price").alias("metric"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("value")))
    side = F.when(F.col("value") > F.col("most"), "max").when(F.col("value") < F.col("least"), "min")
    return v.join(bands, "metric").withColumn("side", side).where("side is not null").select("metric", "id", "value", "side")


PLAUSIBILITY_BANDS = """
with b(metric, least_, most_) as (values ('balance', 0.0, 9000.0), ('price', 905.0, 1900.0)),
v as (select 'balance' as metric, s_suppkey as id, s_acctbal as value from supplier union all select 'price', p_partkey, p_retailprice from part)
select v.metric, id, value, case when value > most_ then 'max' else 'min' end as side from v join b on v.metric = b.metric where value > most_ or value < least_
"""


def ownership_sum(spark, d):
    """Each region's shares of suppliers by nation, against 100."""
    s, n = _read(spark, d, "supplier", "nation")
    k = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_nationkey").agg(F.count(F.lit(1)).alias("k"))
    t = k.groupBy("n_regionkey").agg(F.sum("k").alias("total"))
    share = k.join(t, "n_regionkey").withColumn("share", rounded(F.col("k") * 100.0 / F.col("total"), 1))
    g = share.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("holders"), rounded(F.sum("share"), 1).alias("total_share"))
    return g.withColumn("passes", F.abs(F.col("total_share") - 100) <= 0.15)


OWNERSHIP_SUM = """
with k as (select n_regionkey, n_nationkey, count(*) as k from supplier join nation on s_nationkey = n_nationkey group by 1, 2),
s as (select n_regionkey, floor(k * 100.0 / sum(k) over (partition by n_regionkey) * 10 + 0.5) / 10 as share from k)
select n_regionkey, count(*) as holders, floor(sum(share) * 10 + 0.5) / 10 as total_share, abs(floor(sum(share) * 10 + 0.5) / 10 - 100) <= 0.15 as passes from s group by 1
"""


def ref_codes(spark, d):
    r = cross_source_conflict(spark, d)
    prefix = F.when(F.col("classification") == "VERIFIED_MISMATCH", "VM").when(F.col("classification") == "UNRESOLVED_INCONSISTENCY", "UI").otherwise("OK")
    r = r.withColumn("bucket", F.concat_ws("-", prefix, (F.col("o_orderkey") % 100).cast("string")))
    w = W.partitionBy("bucket").orderBy(F.desc("gap_pct"), "o_orderkey")
    return r.select("o_orderkey", F.concat("bucket", F.lit("-"), numbered(F.row_number().over(w), 5)).alias("ref_code"))


REF_CODES = f"""
with {_REPORTED}, g as (select o_orderkey, floor(abs(stated - lines) / greatest(abs(stated), abs(lines)) * 100 * 10000 + 0.5) / 10000 as gap_pct from r),
b as (select o_orderkey, gap_pct, case when gap_pct <= 2 then 'OK' when gap_pct <= 4 then 'UI' else 'VM' end || '-' || cast(o_orderkey % 100 as varchar) as bucket from g)
select o_orderkey, bucket || '-' || lpad(cast(row_number() over (partition by bucket order by gap_pct desc, o_orderkey) as varchar), 5, '0') as ref_code from b
"""


def question_dedupe(spark, d):
    """The first turn of each normalised text, and how often it comes."""
    (c,) = _read(spark, d, "conversations")
    key = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))
    return c.groupBy(key.alias("question")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("conv_id", "turn")).alias("f")).select("question", "n", F.col("f.conv_id").alias("conv_id"), F.col("f.turn").alias("turn"))


QUESTION_DEDUPE = r"""
with q as (select trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) as question, conv_id, turn from conversations),
r as (select *, count(*) over (partition by question) as n, row_number() over (partition by question order by conv_id, turn) as rn from q)
select question, n, conv_id, turn from r where rn = 1
"""


def comparison_matrix(spark, d):
    (x,) = _read(spark, d, "lineitem")
    return x.groupBy(F.year("l_shipdate").alias("year"), "l_linestatus").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum(F.col("l_quantity").cast("long"))).select("year", "l_linestatus", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"))


COMPARISON_MATRIX = """
select cast(year(l_shipdate) as integer) as year, l_linestatus, cast(sum(case when l_returnflag = 'A' then cast(l_quantity as bigint) end) as bigint) as a,
  cast(sum(case when l_returnflag = 'N' then cast(l_quantity as bigint) end) as bigint) as n, cast(sum(case when l_returnflag = 'R' then cast(l_quantity as bigint) end) as bigint) as r
from lineitem group by 1, 2
"""


def legacy_score(spark, d):
    x, y = _read(spark, d, "documents", "labels")
    g = x.join(y, "doc_id").groupBy("source").agg(F.count_if(F.col("quality") == 0).alias("poor"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_distinct("lang").alias("types"))
    loss = F.floor((1 - F.least(F.col("types") / 5.0, F.lit(1.0))) * 20 + 0.5)
    return g.select("source", F.greatest(F.lit(0), 100 - (F.col("poor") * 15 + F.col("toxic") * 8) - loss).cast("long").alias("score"))


LEGACY_SCORE = """
select source, cast(greatest(0, 100 - (15 * sum(case when quality = 0 then 1 else 0 end) + 8 * sum(case when toxic = 1 then 1 else 0 end))
  - floor((1 - least(count(distinct lang) / 5.0, 1.0)) * 20 + 0.5)) as bigint) as score
from documents join labels using (doc_id) group by source
"""


def most_common_value(spark, d):
    (e,) = _read(spark, d, "events")
    g = e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))
    w = W.partitionBy("user_id").orderBy(F.desc("n"), "first")
    return g.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("user_id", "event_type", "n")


MOST_COMMON_VALUE = """
with g as (select user_id, event_type, count(*) as n, min(event_id) as first_ from events group by 1, 2),
r as (select *, row_number() over (partition by user_id order by n desc, first_) as rn from g)
select user_id, event_type, n from r where rn = 1
"""


def json_cascade(spark, d):
    (e,) = _read(spark, d, "events")
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(-1))
    return e.groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


JSON_CASCADE = "select coalesce(try_cast(json_extract_string(props, '$.k') as bigint), -1) as k, count(*) as n from events group by 1"


def doc_type_classifier(spark, d):
    """The first kind whose key word the start of the text has."""
    (x,) = _read(spark, d, "documents")
    low = F.lower(F.substring("text", 1, 1000))
    kinds = (("deck", ("pitch", "deck")), ("license", ("license", "licensed")), ("table", (" | ",)))
    kind = F.coalesce(*[F.when(F.array_max(F.array(*[F.contains(low, F.lit(w)) for w in words])), k) for k, words in kinds], F.lit("unknown"))
    return x.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


DOC_TYPE_CLASSIFIER = """
select case when contains(t, 'pitch') or contains(t, 'deck') then 'deck' when contains(t, 'license') or contains(t, 'licensed') then 'license'
  when contains(t, ' | ') then 'table' else 'unknown' end as kind, count(*) as n from (select lower(substr(text, 1, 1000)) as t from documents) group by 1
"""


def order_observations(spark, d) -> DataFrame:
    """Observations of a session for each customer: the order's total and its lines, by fiscal month."""
    o, x = _read(spark, d, "orders", "lineitem")
    sums = x.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,4)")).cast("double").alias("lines"))
    j = o.join(sums, F.col("o_orderkey") == F.col("l_orderkey"))
    m = F.month("o_orderdate")
    said = F.array(F.struct(F.lit("orders").alias("document_id"), F.lit("pitch_deck").alias("document_category"), F.col("o_totalprice").alias("v"), F.lit(0).alias("k")), F.struct(F.lit("lineitem").alias("document_id"), F.lit("financial_statements").alias("document_category"), F.col("lines").alias("v"), F.lit(1).alias("k")))
    fy = fiscal_start(m, F.year("o_orderdate"))
    e = j.select("o_orderkey", "o_custkey", m.alias("month"), fy.alias("fy"), F.explode(said).alias("s"))
    one = F.lit(1.0)
    return e.select(
        F.col("o_custkey").cast("string").alias("session_id"), F.col("s.document_id").alias("document_id"), F.col("s.document_id").alias("filename"), F.col("s.document_category").alias("document_category"),
        F.lit("revenue").alias("metric_key"), F.lit("currency").alias("unit"), F.col("s.v").alias("value_base"), F.lit("INR").alias("currency"),
        F.concat(F.format_string("M%02d-", "month"), year_label(F.col("fy"))).alias("period_key"), F.lit("month").alias("granularity"), F.col("fy").cast("int").alias("fy"),
        fiscal_quarter(F.col("month")).alias("quarter"), F.col("month").cast("int").alias("month"), (F.col("fy") * 100 + (F.col("month") + 8) % 12 + 1).alias("sort_key"),
        F.lit("actual").alias("basis_class"), F.lit(None).cast("string").alias("subject"), F.col("o_orderkey").cast("string").alias("quote"),
        one.alias("conf_value"), one.alias("conf_label"), one.alias("conf_period"), one.alias("conf_parse"), (F.col("o_orderkey") * 2 + F.col("s.k")).alias("ordinal"),
    )


def _rates(spark) -> DataFrame:
    return spark.createDataFrame([], "session_id string, currency string, rate double")


def verify_orders(spark, d):
    """The flagship: all sessions' cross-source findings, with class, severity and code."""
    _, f = verify(order_observations(spark, d), _rates(spark), rules=(cross_source,))
    return f.select("session_id", "metric_key", "period_key", "classification", "severity_band", "ref_code", F.col("docs"))


def consensus(spark, d):
    """Consensus, range and outliers of every node of the order observations."""
    n = nodes(order_observations(spark, d), _rates(spark), RulePack())
    return n.select("session_id", "period_key", rounded(F.col("consensus"), 2).alias("consensus"), rounded(F.col("low"), 2).alias("low"), rounded(F.col("high"), 2).alias("high"), "docs")


CONSENSUS = """
with x as (select l_orderkey, cast(sum(cast(l_extendedprice as decimal(18,4))) as double) as v from lineitem group by 1),
o as (select cast(o_custkey as varchar) as session_id, o_orderkey, cast(month(o_orderdate) as integer) as m, cast(case when month(o_orderdate) >= 4 then year(o_orderdate) else year(o_orderdate) - 1 end as integer) as fy, o_totalprice, x.v from orders join x on o_orderkey = l_orderkey),
e as (select session_id, m, fy, o_orderkey * 2 as ordinal, o_totalprice as v from o union all select session_id, m, fy, o_orderkey * 2 + 1, v from o),
r as (select *, row_number() over (partition by session_id, m, fy order by v, ordinal) as rn, count(*) over (partition by session_id, m, fy) as n from e)
select session_id, 'M' || lpad(cast(m as varchar), 2, '0') || '-FY' || cast(fy as varchar) || '-' || lpad(cast((fy + 1) % 100 as varchar), 2, '0') as period_key,
  floor(min(case when rn >= n / 2.0 then v end) * 100 + 0.5) / 100 as consensus, floor(min(v) * 100 + 0.5) / 100 as low, floor(max(v) * 100 + 0.5) / 100 as high, cast(2 as bigint) as docs
from r group by session_id, m, fy
"""

VERIFY_ORDERS = """
with x as (select l_orderkey, cast(sum(cast(l_extendedprice as decimal(18,4))) as double) as v from lineitem group by 1),
o as (select cast(o_custkey as varchar) as session_id, o_orderkey, cast(month(o_orderdate) as integer) as m, cast(case when month(o_orderdate) >= 4 then year(o_orderdate) else year(o_orderdate) - 1 end as integer) as fy, o_totalprice, x.v from orders join x on o_orderkey = l_orderkey),
e as (select session_id, m, fy, o_orderkey * 2 as ordinal, 'deck' as doc, o_totalprice as v from o union all select session_id, m, fy, o_orderkey * 2 + 1, 'statements', v from o),
r as (select *, row_number() over (partition by session_id, m, fy order by v, ordinal) as rn, count(*) over (partition by session_id, m, fy) as n from e),
n as (select session_id, m, fy, min(ordinal) as ordinal, min(v) as low, max(v) as high, min(case when rn >= n / 2.0 then v end) as mid, arg_min(v, ordinal) filter (doc = 'statements') as sure, arg_max(v, ordinal) filter (doc = 'deck') as said from r group by 1, 2, 3),
a as (select session_id, max(abs(mid)) as anchor from n group by 1),
d as (select r.session_id, r.m, r.fy, count(distinct doc) as out from r join n using (session_id, m, fy) where abs(r.v - mid) / abs(mid) * 100 > 2 group by 1, 2, 3),
f as (select n.*, coalesce(out, 0) as out, (high - low) / abs(mid) * 100 as pct, floor((high - low) / abs(mid) * 100 * 1e9 + 0.5) / 1e9 as gap, least((high - low) / (0.05 * anchor), 1.0) as part from n join a using (session_id) left join d using (session_id, m, fy)),
g as (select *, 15.0 * least(greatest(0.4 + 1.6 * case when high > low then 0.6 * least(log10(1 + pct / 2.0) / log10(41.0), 1.0) + 0.4 * part else least(log10(1 + pct / 2.0) / log10(41.0), 1.0) end, 0.4), 2.0)
  * case when said = sure then 1.0 when said > sure then 1.25 else 0.85 end * case when out = 0 then 1.0 when out / 2.0 <= 0.34 then 0.8 else 1.15 end as raw from f),
c as (select *, case when gap <= 2 then 'VERIFIED_CONSISTENT' when gap <= 4 then 'UNRESOLVED_INCONSISTENCY' else 'VERIFIED_MISMATCH' end as class from g),
s as (select *, case when class = 'VERIFIED_CONSISTENT' then 0.0 else floor(least(raw, 100) * 10 + 0.5) / 10 end as severity from c)
select session_id, 'revenue' as metric_key, 'M' || lpad(cast(m as varchar), 2, '0') || '-FY' || cast(fy as varchar) || '-' || lpad(cast((fy + 1) % 100 as varchar), 2, '0') as period_key, class as classification,
  case when class = 'VERIFIED_CONSISTENT' then 'NONE' when raw >= 30 then 'CRITICAL' when raw >= 18 then 'HIGH' when raw >= 9 then 'MEDIUM' else 'MINOR' end as severity_band,
  'REV-R1-' || lpad(cast(row_number() over (partition by session_id order by severity desc, ordinal) as varchar), 3, '0') as ref_code, cast(2 as bigint) as docs
from s
"""

QUERIES = {
    "verify_orders": verify_orders, "consensus": consensus, "fiscal_period_keys": fiscal_period_keys, "money_and_percent": money_and_percent, "fact_nodes": fact_nodes,
    "weighted_median": weighted_median, "cross_source_conflict": cross_source_conflict, "rollup_months_to_fy": rollup_months_to_fy, "growth_break": growth_break,
    "unsupported_claims": unsupported_claims, "plausibility_bands": plausibility_bands, "ownership_sum": ownership_sum, "ref_codes": ref_codes,
    "question_dedupe": question_dedupe, "comparison_matrix": comparison_matrix, "legacy_score": legacy_score, "most_common_value": most_common_value,
    "json_cascade": json_cascade, "doc_type_classifier": doc_type_classifier,
}
ORACLES = {
    "verify_orders": VERIFY_ORDERS, "consensus": CONSENSUS, "fiscal_period_keys": FISCAL_PERIOD_KEYS, "money_and_percent": MONEY_AND_PERCENT, "fact_nodes": FACT_NODES, "weighted_median": WEIGHTED_MEDIAN,
    "cross_source_conflict": CROSS_SOURCE_CONFLICT, "rollup_months_to_fy": ROLLUP_MONTHS_TO_FY, "growth_break": GROWTH_BREAK, "unsupported_claims": UNSUPPORTED_CLAIMS,
    "plausibility_bands": PLAUSIBILITY_BANDS, "ownership_sum": OWNERSHIP_SUM, "ref_codes": REF_CODES, "question_dedupe": QUESTION_DEDUPE, "comparison_matrix": COMPARISON_MATRIX,
    "legacy_score": LEGACY_SCORE, "most_common_value": MOST_COMMON_VALUE, "json_cascade": JSON_CASCADE, "doc_type_classifier": DOC_TYPE_CLASSIFIER,
}

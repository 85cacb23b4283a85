"""Text, periods, labels, sources and guards over the test tables, each with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pyspark.sql import functions as F

from attest.functions.period import fiscal_start, human_period, months_of_quarter, months_of_year, parse_period, quarters_of_year, year_label
from attest.functions.text import amount_text, figure_text, number_of, percent_text, rounded, scale_of, value_of
from attest.operators import explain, facts, guards, serving
from attest.operators.canonicalize import canonical, matched_alias, matched_labels, reconciled, subject_of
from attest.plans.rulepack import TOLERANCE_PCT, RulePack
from attest.sources import sheets
from attest.sources.intake import intake
from attest.sources.session import shared
from attest.tables import SessionTable



def _read(spark, d: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{d}/{n}.parquet") for n in names]


def figures_in_text(spark, d):
    """Suppliers' balances written in several ways, read back: scale, number, value, confidence."""
    (s,) = _read(spark, d, "supplier")
    n = F.floor(F.abs("s_acctbal")).cast("long").cast("string")
    kinds = [F.concat(F.lit("Rs. "), n, F.lit(" Cr")), F.concat(n, F.lit("lakh")), F.concat(F.lit("("), n, F.lit(")")), F.concat(n, F.lit("%")), F.concat(F.lit("see note "), n), F.concat(F.lit("-$"), n, F.lit(" million")), F.concat(n, F.lit("k -"))]
    t = s.withColumn("raw", F.element_at(F.array(*kinds), (F.col("s_suppkey") % 7 + 1).cast("int")))
    v = value_of(F.col("raw"), F.lit(None).cast("double"), F.lit("currency"))
    return t.select("s_suppkey", scale_of(F.col("raw")).alias("scale"), number_of(F.col("raw")).alias("number"), v["value"].alias("value"), v["currency"].alias("currency"), v["conf"].alias("conf"))


FIGURES_IN_TEXT = """
with s as (select s_suppkey, s_suppkey % 7 as k, cast(cast(floor(abs(s_acctbal)) as bigint) as double) as n from supplier)
select s_suppkey, cast(case k when 0 then 1e7 when 1 then 1e5 when 5 then 1e6 when 6 then 1e3 else 1.0 end as double) as scale, case when k in (2, 5, 6) then -n else n end as number,
  case k when 0 then n * 1e7 when 1 then n * 1e5 when 2 then -n when 3 then n when 5 then -n * 1e6 when 6 then -n * 1e3 end as value,
  case k when 0 then 'INR' when 5 then 'USD' end as currency, cast(case k when 3 then 0.5 else 1.0 end as double) as conf from s
"""


def written_figures(spark, d):
    """Amounts, percentages and other figures as texts."""
    (s,) = _read(spark, d, "supplier")
    whole = F.floor("s_acctbal").cast("double")
    return s.select("s_suppkey", amount_text(whole * 1234, F.lit("INR")).alias("amount"), percent_text(whole / 8).alias("percent"), figure_text(whole / 4, F.lit("months"), F.lit(None).cast("string")).alias("months"), figure_text(whole / 8, F.lit("ratio"), F.lit(None).cast("string")).alias("ratio"))


def _plain(v: str, places: int) -> str:
    return f"regexp_replace(regexp_replace(printf('%.{places}f', floor({v} * {10**places} + 0.5) / {10**places}), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"


_WHOLE = "cast(cast(floor(abs(v * 1234) + 0.5) as bigint) as varchar)"
_PAIRS = f"reverse(regexp_replace(reverse(left({_WHOLE}, length({_WHOLE}) - 3)), '(\\d\\d)', '\\1,', 'g'))"
WRITTEN_FIGURES = f"""
with s as (select s_suppkey, floor(s_acctbal) as v from supplier)
select s_suppkey, 'Rs ' || case when v < 0 then '-' else '' end || case when length({_WHOLE}) <= 3 then {_WHOLE} else ltrim({_PAIRS}, ',') || ',' || right({_WHOLE}, 3) end as amount,
  {_plain('v / 8', 2)} || '%' as percent, {_plain('v / 4', 1)} || ' months' as months, {_plain('v / 8', 2)} || 'x' as ratio from s
"""


def human_periods(spark, d):
    """Months of orders in words, and the keys of their year and quarter."""
    (o,) = _read(spark, d, "orders")
    m = F.month("o_orderdate")
    fy = fiscal_start(m, F.year("o_orderdate"))
    k = o.select(fy.alias("fy"), m.alias("month"), (F.floor((m + 8) % 12 / 3) + 1).cast("int").alias("quarter")).distinct()
    key = F.concat(F.format_string("M%02d-", "month"), year_label(F.col("fy")))
    return k.select(key.alias("period_key"), human_period(key).alias("said"), F.get(months_of_year(F.col("fy")), 0).alias("first_month"), F.array_join(quarters_of_year(F.col("fy")), " ").alias("quarters"), F.array_join(months_of_quarter(F.col("fy"), F.col("quarter")), " ").alias("months"))


_FY = "'FY' || cast(fy as varchar) || '-' || lpad(cast((fy + 1) % 100 as varchar), 2, '0')"
_MONTH = "'M' || lpad(cast((({}) + 3) % 12 + 1 as varchar), 2, '0') || '-' || " + _FY
HUMAN_PERIODS = f"""
with o as (select distinct case when month(o_orderdate) >= 4 then year(o_orderdate) else year(o_orderdate) - 1 end as fy, month(o_orderdate) as month, year(o_orderdate) as year, monthname(o_orderdate) as name from orders)
select 'M' || lpad(cast(month as varchar), 2, '0') || '-' || {_FY} as period_key, name || ' ' || cast(year as varchar) as said, {_MONTH.format('0')} as first_month,
  'Q1-' || {_FY} || ' Q2-' || {_FY} || ' Q3-' || {_FY} || ' Q4-' || {_FY} as quarters,
  {_MONTH.format('((month + 8) % 12) // 3 * 3')} || ' ' || {_MONTH.format('((month + 8) % 12) // 3 * 3 + 1')} || ' ' || {_MONTH.format('((month + 8) % 12) // 3 * 3 + 2')} as months from o
"""


def parsed_periods(spark, d):
    """Order dates written as month and year, quarter, fiscal year or bare year, and read back."""
    (o,) = _read(spark, d, "orders")
    m, y = F.month("o_orderdate"), F.year("o_orderdate")
    fy = fiscal_start(m, y)
    texts = [F.date_format("o_orderdate", "MMMM yyyy"), F.concat(F.lit("Q"), (F.floor((m + 8) % 12 / 3) + 1).cast("string"), F.lit(" FY"), F.substring((fy + 1).cast("string"), 3, 2)), F.concat(F.lit("FY"), F.substring((fy + 1).cast("string"), 3, 2)), F.concat(F.lit("year "), F.lit("2")), y.cast("string")]
    t = o.withColumn("raw", F.element_at(F.array(*texts), (F.col("o_orderkey") % 5 + 1).cast("int")))
    p = parse_period(t, "raw", "p")
    return p.groupBy("p.period_key", "p.granularity", "p.quality").agg(F.count(F.lit(1)).alias("n"))


PARSED_PERIODS = f"""
with o as (select o_orderkey % 5 as k, month(o_orderdate) as m, year(o_orderdate) as y, case when month(o_orderdate) >= 4 then year(o_orderdate) else year(o_orderdate) - 1 end as fy0 from orders),
p as (select k, m, y, case when k = 4 then y - 1 else fy0 end as fy from o)
select case k when 0 then 'M' || lpad(cast(m as varchar), 2, '0') || '-' || {_FY} when 1 then 'Q' || cast(((m + 8) % 12) // 3 + 1 as varchar) || '-' || {_FY} when 3 then 'REL-Y2' else {_FY} end as period_key,
  case k when 0 then 'month' when 1 then 'quarter' else 'fy' end as granularity, case k when 3 then 'relative' when 4 then 'inferred' else 'exact' end as quality, count(*) as n from p group by 1, 2, 3
"""

#: Aliases for names of parts, as names of metrics would have them.
_ALIASES = [("red", "revenue"), ("red widget", "ebitda"), ("widget", "cogs"), ("small", "opex"), ("small ring", "equity"), ("ring", "arr"), ("blue", "mrr"), ("bolt", "cac"), ("large bolt", "ltv")]


def alias_longest_match(spark, d):
    (p,) = _read(spark, d, "part")
    hit = matched_alias(F.col("p_name"), _ALIASES)
    return p.select("p_partkey", hit["alias"].alias("alias"), hit["key"].alias("metric_key"))


ALIAS_LONGEST_MATCH = """
with a(alias, key, i) as (values """ + ", ".join(f"('{a}', '{k}', {i})" for i, (a, k) in enumerate(_ALIASES)) + """),
h as (select p_partkey, alias, key, row_number() over (partition by p_partkey order by length(alias) desc, i) as rn from part join a on contains(' ' || lower(p_name) || ' ', ' ' || alias || ' '))
select part.p_partkey, alias, key as metric_key from part left join h on h.p_partkey = part.p_partkey and rn = 1
"""


def _raw_records(spark, d: str) -> tuple[DataFrame, DataFrame]:
    (p,) = _read(spark, d, "part")
    k = F.col("p_partkey")
    raw = p.select(
        F.col("p_brand").alias("session_id"), F.lit("D").alias("document_id"), F.col("p_name").alias("raw_label"), F.when(k % 5 == 0, "revenue").alias("metric_key"),
        F.when(k % 11 == 0, "n/a").when(k % 4 == 0, F.concat(F.col("p_size").cast("string"), F.lit("%"))).otherwise(F.concat(F.lit("Rs "), F.col("p_size").cast("string"), F.lit(" Cr"))).alias("value_raw"), F.lit(None).cast("string").alias("value"),
        F.lit("FY25").alias("period"), F.lit(None).cast("string").alias("period_type"), F.lit(None).cast("string").alias("basis"), F.when(k % 7 != 0, F.col("p_type")).alias("source_quote"), F.lit(None).cast("string").alias("source_cell"),
        F.lit(0.9).alias("confidence"), k.alias("ordinal"),
    )
    docs = p.select(F.col("p_brand").alias("session_id")).distinct().select("session_id", F.lit("D").alias("document_id"), F.lit("d.pdf").alias("filename"), F.lit("mis").alias("document_category"), F.lit(".pdf").alias("file_type"), F.lit(None).cast("string").alias("period_hint"))
    return raw, docs


def citation_gate(spark, d):
    """Why records are dropped, and of what metric and agreement those kept are."""
    raw, docs = _raw_records(spark, d)
    c = canonical(raw, docs, _ALIASES)
    kept = lambda x: F.when(F.col("dropped").isNull(), F.col(x))
    return c.groupBy(F.coalesce("dropped", F.lit("kept")).alias("dropped"), kept("metric_key").alias("metric_key"), kept("label_agreement").alias("agreement"), kept("conf_label").alias("conf_label")).agg(F.count(F.lit(1)).alias("n"))


CITATION_GATE = f"""
with a as ({ALIAS_LONGEST_MATCH}), r as (select part.p_partkey, p_type, a.metric_key as alias, case when part.p_partkey % 5 = 0 then 'revenue' end as claim, part.p_partkey % 4 = 0 and part.p_partkey % 11 <> 0 as pct from part join a using (p_partkey)),
m as (select *, coalesce(alias, claim) as metric, case when alias = claim then 'both' when alias is not null and claim is not null then 'conflict' when alias is not null then 'alias_only' when claim is not null then 'model_only' else 'none' end as how from r),
g as (select *, case when p_partkey % 7 = 0 then 'missing_source_quote' when metric is null then 'unresolvable_metric' when p_partkey % 11 = 0 then 'unparseable_value' else 'kept' end as dropped,
  case how when 'both' then 1.0 when 'conflict' then 0.7 when 'alias_only' then 0.9 else 0.65 end * case when pct and metric = 'ebitda' then 0.8 when pct then 0.55 else 1.0 end as conf,
  case when pct and metric = 'ebitda' then 'ebitda_margin' else metric end as final from m)
select dropped, case when dropped = 'kept' then final end as metric_key, case when dropped = 'kept' then how end as agreement, cast(case when dropped = 'kept' then conf end as double) as conf_label, count(*) as n from g group by all
"""


def record_counts(spark, d):
    """How many records each session's reasons have, as a map by reason."""
    c = canonical(*_raw_records(spark, d), _ALIASES)
    g = serving.count_by(c, ["session_id"], F.col("dropped"))
    return g.select("session_id", F.explode("counts").alias("reason", "n"))


RECORD_COUNTS = f"""
with a as ({ALIAS_LONGEST_MATCH}), g as (select p_brand as session_id, case when p.p_partkey % 7 = 0 then 'missing_source_quote' when a.metric_key is null and p.p_partkey % 5 <> 0 then 'unresolvable_metric' when p.p_partkey % 11 = 0 then 'unparseable_value' else 'unknown' end as reason from part p join a using (p_partkey))
select session_id, reason, count(*) as n from g group by 1, 2
"""


def low_extraction(spark, d):
    raw, docs = _raw_records(spark, d)
    return guards.low_extraction(docs, canonical(raw, docs, _ALIASES))


LOW_EXTRACTION = f"""
with a as ({ALIAS_LONGEST_MATCH}), g as (select p_brand as session_id, p.p_partkey % 7 = 0 or (a.metric_key is null and p.p_partkey % 5 <> 0) or p.p_partkey % 11 = 0 as lost from part p join a using (p_partkey)),
c as (select session_id, 'D' as document_id, count(*) filter (not lost) as kept, count(*) filter (lost) as dropped from g group by 1)
select *, case when kept = 0 then 'no_figures_extracted' else 'high_discard_rate' end as code from c where kept = 0 or dropped / cast(dropped + kept as double) > 0.4
"""


def reconciled_units(spark, d):
    """What a percentage or an amount does to a metric's key."""
    (p,) = _read(spark, d, "part")
    metric = F.element_at(F.array(*[F.lit(x) for x in ("ebitda", "gross_margin", "revenue", "headcount")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    shown = F.when(F.col("p_size") % 2 == 0, "pct").otherwise("currency")
    key, conf = reconciled(metric, shown)
    return p.groupBy(metric.alias("metric"), shown.alias("shown"), key.alias("metric_key"), conf.alias("conf")).agg(F.count(F.lit(1)).alias("n"))


RECONCILED_UNITS = """
with p as (select case p_partkey % 4 when 0 then 'ebitda' when 1 then 'gross_margin' when 2 then 'revenue' else 'headcount' end as metric, case when p_size % 2 = 0 then 'pct' else 'currency' end as shown from part)
select metric, shown, case when metric = 'ebitda' and shown = 'pct' then 'ebitda_margin' when metric = 'gross_margin' and shown = 'currency' then 'gross_profit' else metric end as metric_key,
  cast(case when (metric = 'ebitda' and shown = 'pct') or (metric = 'gross_margin' and shown = 'currency') then 0.8 when metric = 'headcount' or (metric = 'revenue' and shown = 'pct') then 0.55 else 1.0 end as double) as conf, count(*) as n from p group by all
"""


def holder_names(spark, d):
    """Holders' names out of labels of ownership."""
    (c,) = _read(spark, d, "customer")
    label = F.concat(F.initcap("c_mktsegment"), F.lit(" Holdings (fully diluted) - equity "), (F.col("c_custkey") % 3).cast("string"), F.lit(" stake %"))
    return c.groupBy(subject_of(F.lit("ownership"), label).alias("holder")).agg(F.count(F.lit(1)).alias("n"))


HOLDER_NAMES = "select lower(c_mktsegment) || ' - ' || cast(c_custkey % 3 as varchar) as holder, count(*) as n from customer group by 1"


def document_kinds(spark, d):
    """Documents by the reference words of each kind, with a file's name before the text."""
    (x,) = _read(spark, d, "documents")
    name = F.concat(F.element_at(F.array(F.lit("q3 deck"), F.lit("mis march"), F.lit("promise"), F.lit("cap table"), F.lit("forecast"), F.lit("notes")), (F.col("doc_id") % 6 + 1).cast("int")), F.lit(".pdf"))
    return x.groupBy(sheets.document_kind(F.col("text"), name).alias("kind"), sheets.reader_of(name).alias("reader")).agg(F.count(F.lit(1)).alias("n"))


DOCUMENT_KINDS = r"""
with t as (select lower(case doc_id % 6 when 0 then 'q3 deck' when 1 then 'mis march' when 2 then 'promise' when 3 then 'cap table' when 4 then 'forecast' else 'notes' end || '.pdf ' || substr(coalesce(text, ''), 1, 1000)) as t from documents)
select case when contains(t, 'pitch') or contains(t, 'deck') or contains(t, 'investor presentation') then 'pitch_deck'
  when contains(t, 'balance sheet') or contains(t, 'income statement') or contains(t, 'cash flow') or contains(t, 'profit and loss') or contains(t, 'p&l') then 'financial_statements'
  when contains(t, 'cap table') or contains(t, 'capitalization') or contains(t, 'shareholder') or contains(t, 'equity holding') then 'cap_table'
  when contains(t, 'projection') or contains(t, 'forecast') or contains(t, 'budget') then 'projections'
  when regexp_matches(t, '\bmis\b') or contains(t, 'management information') or contains(t, 'dashboard') or contains(t, 'kpi') then 'mis' else 'unknown' end as kind, 'page' as reader, count(*) as n from t group by 1
"""


def chunk_documents(spark, d):
    """Chunks of about 2000 characters of whole texts: how many, and how long."""
    (x,) = _read(spark, d, "documents")
    e = x.select("doc_id", F.posexplode(sheets.chunks(F.col("text"), 2000)).alias("i", "chunk"))
    return e.select("doc_id", F.col("i").cast("int").alias("i"), F.char_length("chunk").cast("long").alias("n"))


CHUNK_DOCUMENTS = r"""
with recursive t as (select doc_id, text from documents where length(text) > 2000),
l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from t),
k as (select doc_id, i, length(line) as n, regexp_matches(lower(line), '^\s*(#+\s*)?(page|slide)\s+\d+') or regexp_matches(line, '^---\s*$') as opens, trim(line, chr(32) || chr(9) || chr(13)) = '' as blank from l),
r as (select doc_id, i, n + 1 as size, 0 as c from k where i = 1
  union all select k.doc_id, k.i, case when r.size > 0 and ((r.size + k.n > 2000 and k.opens) or r.size + k.n > 2600) then k.n + 1 else r.size + k.n + 1 end,
    r.c + case when r.size > 0 and ((r.size + k.n > 2000 and k.opens) or r.size + k.n > 2600) then 1 else 0 end from r join k on k.doc_id = r.doc_id and k.i = r.i + 1),
s as (select r.doc_id, r.c as i, sum(k.n + 1) as n, bool_and(k.blank) as blank, max(r.c) over (partition by r.doc_id) as last from r join k on k.doc_id = r.doc_id and k.i = r.i group by r.doc_id, r.c)
select doc_id, cast(0 as integer) as i, length(text) as n from documents where length(text) between 1 and 2000
union all select doc_id, cast(i as integer), cast(n as bigint) from s where not (blank and i = last)
"""


def column_letters(spark, d):
    (p,) = _read(spark, d, "part")
    return p.select("p_partkey", sheets.column_letter(F.col("p_partkey")).alias("letters"))


COLUMN_LETTERS = """
select p_partkey, case when p_partkey < 26 then chr(cast(65 + p_partkey as integer)) when p_partkey < 702 then chr(cast(64 + p_partkey // 26 as integer)) || chr(cast(65 + p_partkey % 26 as integer))
  else chr(cast(65 + (p_partkey // 26 - 1) // 26 - 1 as integer)) || chr(cast(65 + (p_partkey // 26 - 1) % 26 as integer)) || chr(cast(65 + p_partkey % 26 as integer)) end as letters from part
"""


def cell_texts(spark, d):
    """What cells show: shares in a percent format, day numbers, shown texts, plain values."""
    (x,) = _read(spark, d, "lineitem")
    x = x.where("l_linenumber <= 4")
    k = F.col("l_linenumber")
    kind = F.when(k == 2, "day").otherwise("number")
    value = F.when(k == 2, F.col("l_quantity").cast("long").cast("string")).when(k == 1, F.format_string("%.2f", F.col("l_discount") + 0.0)).otherwise(F.col("l_partkey").cast("string"))
    text = sheets.cell_text(kind, value, F.when(k == 3, F.concat(F.lit(" "), F.col("l_suppkey").cast("string"), F.lit(" "))), F.when(k == 1, "0.00%"))
    return x.groupBy(k.alias("kind"), text.alias("text")).agg(F.count(F.lit(1)).alias("n"))


CELL_TEXTS = r"""
with x as (select l_linenumber as kind, case l_linenumber when 1 then regexp_replace(regexp_replace(printf('%.4f', floor(cast(printf('%.2f', l_discount + 0.0) as double) * 100 * 10000 + 0.5) / 10000), '(\.\d*?)0+$', '\1'), '\.$', '') || '%'
  when 2 then strftime(date '1899-12-30' + cast(l_quantity as integer), '%Y-%m-%d') when 3 then cast(l_suppkey as varchar) else cast(l_partkey as varchar) end as text from lineitem where l_linenumber <= 4)
select kind, text, count(*) as n from x group by 1, 2
"""


def company_mismatch(spark, d):
    """Nations whose customers' segments, as company names, are not all related."""
    (c,) = _read(spark, d, "customer")
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.concat(F.lower("c_mktsegment"), F.lit(" Ltd"))).otherwise(F.col("c_mktsegment"))
    s = c.select(F.concat(F.col("c_nationkey").cast("string"), F.lit("-"), (k % 50).cast("string")).alias("session_id"), name.alias("company_name"))
    return guards.company_mismatch(s).select("session_id", F.array_join("names", "|").alias("names"))


COMPANY_MISMATCH = """
with c as (select distinct cast(c_nationkey as varchar) || '-' || cast(c_custkey % 50 as varchar) as session_id, lower(case when c_custkey % 3 = 0 then lower(c_mktsegment) || ' Ltd' else c_mktsegment end) as name from customer),
g as (select session_id, string_agg(name, '|' order by name) as names, count(*) as n from c group by 1 having count(*) > 1)
select session_id, names from g where exists (select 1 from c a where a.session_id = g.session_id and not exists (select 1 from c b where b.session_id = a.session_id and b.name <> a.name and (contains(a.name, b.name) or contains(b.name, a.name))))
"""


def input_gate(spark, d):
    """Suppliers' lines as documents of orders: too few, too few kinds, or enough."""
    o, x = _read(spark, d, "orders", "lineitem")
    sessions = o.select(F.col("o_orderkey").cast("string").alias("session_id"))
    docs = x.select(F.col("l_orderkey").cast("string").alias("session_id"), F.when(F.col("l_returnflag") == "N", "unknown").otherwise(F.col("l_returnflag")).alias("document_category"))
    return guards.input_gate(sessions, docs).groupBy("ok", "code").agg(F.count(F.lit(1)).alias("n"))


INPUT_GATE = """
with s as (select o_orderkey, count(l_orderkey) as n, count(distinct case when l_returnflag <> 'N' then l_returnflag end) as kinds from orders left join lineitem on l_orderkey = o_orderkey group by 1),
c as (select case when n = 0 then 'no_files' when n < 2 then 'too_few_documents' when kinds < 2 then 'too_few_document_types' end as code from s)
select code is null as ok, code, count(*) as n from c group by all
"""


def question_keys(spark, d):
    """Turns by their question without case, marks and filler words."""
    (c,) = _read(spark, d, "conversations")
    return c.groupBy(explain.normalised_question(F.col("text")).alias("question")).agg(F.count(F.lit(1)).alias("n"))


QUESTION_KEYS = r"""
with q as (select trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', '', 'g'), '\b(the|a|an|your|of|for|in|and|is|are|can|you|please|provide|which|what)\b', '', 'g'), '\s+', ' ', 'g')) as question from conversations)
select question, count(*) as n from q group by 1
"""


def json_answers(spark, d):
    """Events' properties inside a fence, after thinking, or broken, read back."""
    (e,) = _read(spark, d, "events")
    k = F.col("event_id") % 3
    text = F.when(k == 0, F.concat(F.lit("said\n```json\n"), "props", F.lit("\n```\nend"))).when(k == 1, F.concat(F.lit("<think>{no}</think> so "), "props", F.lit(" it is"))).otherwise(F.concat(F.lit("none: "), F.substring("props", 2, 100)))
    got = F.get_json_object(serving.json_answer(text), "$.k").try_cast("long")
    return e.groupBy(k.alias("kind"), got.alias("k")).agg(F.count(F.lit(1)).alias("n"))


JSON_ANSWERS = "select event_id % 3 as kind, case when event_id % 3 < 2 then cast(json_extract_string(props, '$.k') as bigint) end as k, count(*) as n from events group by all"


def common_values(spark, d):
    """Each user's most common type of event, whatever its case, as first written."""
    (e,) = _read(spark, d, "events")
    t = e.withColumn("event_type", F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")))
    return serving.most_common(t, ["user_id"], "event_type", "event_id")


COMMON_VALUES = """
with t as (select user_id, event_id, case when event_id % 2 = 0 then upper(event_type) else event_type end as event_type from events),
g as (select user_id, lower(event_type) as low, count(*) as n, arg_min(event_type, event_id) as event_type, min(event_id) as first_ from t group by 1, 2),
r as (select *, row_number() over (partition by user_id order by n desc, first_) as rn from g)
select user_id, event_type, n from r where rn = 1
"""


def earlier_score(spark, d):
    """The earlier scoring over labelled documents as counts of classes."""
    x, y = _read(spark, d, "documents", "labels")
    g = x.join(y, "doc_id").groupBy(F.col("source").alias("session_id")).agg(F.count_if(F.col("quality") == 0).alias("mismatches"), F.count_if(F.col("toxic") == 1).alias("missing"), F.lit(0).alias("unusual"), F.count_if(F.col("lang") == "de").alias("inconsistencies"), F.count_distinct("lang").alias("kinds"))
    return serving.legacy_score(g)


EARLIER_SCORE = """
select source as session_id, cast(greatest(0, 100 - (15 * count(*) filter (quality = 0) + 10 * count(*) filter (toxic = 1) + 5 * count(*) filter (lang = 'de')) - floor((1 - least(count(distinct lang) / 5.0, 1.0)) * 20 + 0.5)) as bigint) as score
from documents join labels using (doc_id) group by 1
"""


def _fx_observations(spark, d: str) -> DataFrame:
    """Balances of suppliers and customers of a nation, in four currencies, as two documents' figures."""
    s, c = _read(spark, d, "supplier", "customer")
    cur = lambda k: F.element_at(F.array(F.lit("INR"), F.lit("usd"), F.lit("EUR"), F.lit("GBP")), (k % 4 + 1).cast("int"))
    one = F.lit(1.0)
    say = lambda t, key, nation, value, doc: t.select(F.col(nation).cast("string").alias("session_id"), F.lit(doc).alias("document_id"), F.lit(doc).alias("filename"), F.lit("mis").alias("document_category"), F.lit("equity").alias("metric_key"), F.lit("currency").alias("unit"), F.floor(F.col(value)).cast("double").alias("value_base"), cur(F.col(key)).alias("currency"), F.col(key).alias("k"))
    e = say(s, "s_suppkey", "s_nationkey", "s_acctbal", "S").unionByName(say(c, "c_custkey", "c_nationkey", "c_acctbal", "C"))
    none = F.lit(None).cast("int")
    return e.select("session_id", "document_id", "filename", "document_category", "metric_key", "unit", "value_base", "currency", F.concat(F.lit("P"), (F.col("k") % 10).cast("string")).alias("period_key"), F.lit("unknown").alias("granularity"), none.alias("fy"), none.alias("quarter"), none.alias("month"), none.alias("sort_key"), F.lit("actual").alias("basis_class"), F.lit(None).cast("string").alias("subject"), F.lit("q").alias("quote"), one.alias("conf_value"), one.alias("conf_label"), one.alias("conf_period"), one.alias("conf_parse"), (F.col("k") * 2 + (F.col("document_id") == "C").cast("int")).alias("ordinal"))


def _fx_rates(spark) -> DataFrame:
    raw = spark.createDataFrame([(str(i), '{"USD_INR": 83.5, "EUR": "90", "GBP_INR": -1, "source": "x"}') for i in range(25)], "session_id string, fx_rates string")
    return facts.parsed_rates(raw)


def fx_facts(spark, d):
    """Facts of figures in four currencies: two have a rate, one has none and stays blocked in its own scope."""
    n = facts.nodes(_fx_observations(spark, d), _fx_rates(spark))
    return n.select("session_id", "period_key", "currency_scope", "blocked_reason", rounded(F.col("low"), 2).alias("low"), rounded(F.col("high"), 2).alias("high"), rounded(F.col("consensus"), 2).alias("consensus"), "docs", "crossed_currency")


FX_FACTS = """
with e as (select cast(s_nationkey as varchar) as session_id, 'S' as doc, floor(s_acctbal) as v, s_suppkey as k from supplier union all select cast(c_nationkey as varchar), 'C', floor(c_acctbal), c_custkey from customer),
r as (select *, case k % 4 when 0 then 1.0 when 1 then 83.5 when 2 then 90.0 end as rate, case k % 4 when 0 then 'INR' when 1 then 'USD' when 2 then 'EUR' else 'GBP' end as cur, 'P' || cast(k % 10 as varchar) as period_key, k * 2 + case when doc = 'C' then 1 else 0 end as ordinal from e),
a as (select *, case when rate is null then 'GBP' else 'ANCHOR' end as currency_scope, cast(v * rate as double) as x from r),
w as (select *, row_number() over (partition by session_id, period_key, currency_scope order by x, ordinal) as rn, count(*) over (partition by session_id, period_key, currency_scope) as n from a)
select session_id, period_key, currency_scope, case when currency_scope = 'GBP' then 'currency_mismatch' end as blocked_reason, floor(min(x) * 100 + 0.5) / 100 as low, floor(max(x) * 100 + 0.5) / 100 as high,
  floor(min(case when rn >= n / 2.0 then x end) * 100 + 0.5) / 100 as consensus, count(distinct doc) as docs, count(distinct cur) > 1 as crossed_currency from w group by 1, 2, 3
"""


def tolerances(spark, d):
    """The tolerance of each metric of the pack, over parts."""
    (p,) = _read(spark, d, "part")
    names = [*TOLERANCE_PCT, "gross_margin", "depreciation_amortization"]
    metric = F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("p_partkey") % len(names) + 1).cast("int"))
    value, points = facts.tolerance_of(metric, F.when(metric == "gross_margin", "pct").otherwise("currency"), RulePack())
    return p.groupBy(metric.alias("metric_key"), value.alias("tolerance"), points.alias("in_points")).agg(F.count(F.lit(1)).alias("n"))


_NAMES = [*TOLERANCE_PCT, "gross_margin", "depreciation_amortization"]
TOLERANCES = "with t(i, metric_key, tolerance, in_points) as (values " + ", ".join(f"({i}, '{m}', {TOLERANCE_PCT.get(m, 0.2 if m == 'gross_margin' else 2.0)}::double, {str(m == 'gross_margin').lower()})" for i, m in enumerate(_NAMES)) + f") select metric_key, tolerance, in_points, count(*) as n from part join t on p_partkey % {len(_NAMES)} = i group by all"

def intake_documents(spark, d):
    """Events as a reader's answers, some missing, cut off or wrapped otherwise: what each document gives."""
    (e,) = _read(spark, d, "events")
    k = F.col("event_id") % 7
    record = F.concat(F.lit('{"raw_label": "'), "event_type", F.lit('", "value": '), F.col("event_id").cast("string"), F.lit(', "nested": '), "props", F.lit(', "company_name": "C'), (F.col("event_id") % 3).cast("string"), F.lit('"}'))
    answer = (
        F.when(k == 0, F.lit(None))
        .when(k == 1, F.concat(F.lit('{"observations": ['), record))
        .when(k == 2, F.concat(F.lit('{"metrics": ['), record, F.lit(", 5]}")))
        .when(k == 3, F.concat(F.lit('{"observations": '), record, F.lit("}")))
        .otherwise(F.concat(F.lit('{"observations": ['), record, F.lit(", "), record, F.lit("]}")))
    )
    a = e.select(F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("document_id"), F.col("event_id").alias("chunk"), answer.alias("answer"))
    return intake(a).documents.drop("company_name")


INTAKE_DOCUMENTS = """
with a as (select cast(user_id as varchar) as session_id, event_type as document_id, event_id % 7 as k from events)
select session_id, document_id, count(*) as chunks, count(*) filter (k in (0, 1, 3)) as failed_chunks, cast(sum(case k when 2 then 1 when 4 then 2 when 5 then 2 when 6 then 2 else 0 end) as bigint) as records,
  count(*) filter (k = 2) as failed_records, count(*) filter (k in (0, 1, 3)) = count(*) as failed from a group by 1, 2
"""


def alias_join(spark, d):
    """The longest alias of each part's name, from a table of aliases: every word of the names, and pairs of them."""
    (p,) = _read(spark, d, "part")
    words = F.split(F.lower("p_name"), " ")
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)))
    table = p.where("p_partkey % 10 = 0").select(F.explode(F.array_union(words, F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>")))).alias("alias")).distinct()
    found = matched_labels(p.select(F.col("p_name").alias("raw_label")), table.select("alias", F.upper("alias").alias("key"), F.crc32(F.col("alias").cast("binary")).alias("place")))
    return found.groupBy(F.length("alias").cast("long").alias("length")).agg(F.count(F.lit(1)).alias("labels"))


ALIAS_JOIN = """
with w as (select distinct p_name, string_split(lower(p_name), ' ') as w, p_partkey from part),
t as (select distinct unnest(list_concat(w, case when len(w) > 1 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) else [] end)) as alias from w where p_partkey % 10 = 0),
h as (select p_name, max(length(alias)) as n from (select distinct p_name from part) join t on contains(' ' || lower(p_name) || ' ', ' ' || alias || ' ') group by 1)
select cast(n as bigint) as length, count(*) as labels from h group by 1
"""


def session_table(spark, d):
    """Figures in a table of sessions: written, half of the sessions replaced, one looked up."""
    (s,) = _read(spark, d, "supplier")
    rows = s.select(F.col("s_nationkey").cast("string").alias("session_id"), F.col("s_suppkey").alias("figure"), F.lit(1).alias("edition"))
    t = SessionTable(spark, f"{shared(spark)}/sessions", buckets=16)
    t.append(rows)
    t.replace(rows.where("session_id % 2 = 0").withColumn("edition", F.lit(2)))
    every = t.read().groupBy("session_id", "edition").agg(F.count(F.lit(1)).alias("n"), F.lit(False).alias("looked_up"))
    return every.unionByName(t.lookup("4").groupBy("session_id", "edition").agg(F.count(F.lit(1)).alias("n"), F.lit(True).alias("looked_up")))


SESSION_TABLE = """
with s as (select cast(s_nationkey as varchar) as session_id, cast(case when s_nationkey % 2 = 0 then 2 else 1 end as integer) as edition, count(*) as n from supplier group by 1, 2)
select *, false as looked_up from s union all select *, true from s where session_id = '4'
"""

QUERIES = {
    "intake_documents": intake_documents, "alias_join": alias_join, "session_table": session_table,
    "figures_in_text": figures_in_text, "written_figures": written_figures, "human_periods": human_periods, "parsed_periods": parsed_periods, "alias_longest_match": alias_longest_match, "citation_gate": citation_gate,
    "record_counts": record_counts, "low_extraction": low_extraction, "reconciled_units": reconciled_units, "holder_names": holder_names, "document_kinds": document_kinds, "chunk_documents": chunk_documents,
    "column_letters": column_letters, "cell_texts": cell_texts, "company_mismatch": company_mismatch, "input_gate": input_gate, "question_keys": question_keys, "json_answers": json_answers, "common_values": common_values,
    "earlier_score": earlier_score, "fx_facts": fx_facts, "tolerances": tolerances,
}
ORACLES = {
    "intake_documents": INTAKE_DOCUMENTS, "alias_join": ALIAS_JOIN, "session_table": SESSION_TABLE,
    "figures_in_text": FIGURES_IN_TEXT, "written_figures": WRITTEN_FIGURES, "human_periods": HUMAN_PERIODS, "parsed_periods": PARSED_PERIODS, "alias_longest_match": ALIAS_LONGEST_MATCH, "citation_gate": CITATION_GATE,
    "record_counts": RECORD_COUNTS, "low_extraction": LOW_EXTRACTION, "reconciled_units": RECONCILED_UNITS, "holder_names": HOLDER_NAMES, "document_kinds": DOCUMENT_KINDS, "chunk_documents": CHUNK_DOCUMENTS,
    "column_letters": COLUMN_LETTERS, "cell_texts": CELL_TEXTS, "company_mismatch": COMPANY_MISMATCH, "input_gate": INPUT_GATE, "question_keys": QUESTION_KEYS, "json_answers": JSON_ANSWERS, "common_values": COMMON_VALUES,
    "earlier_score": EARLIER_SCORE, "fx_facts": FX_FACTS, "tolerances": TOLERANCES,
}

"""Tables that a reader of the results asks for: scans, pivots, filters, counts, and sections of a report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attest.functions.period import comparable
from attest.functions.text import plain_number, rounded
from attest.plans.rulepack import RulePack

# Class weights of the earlier scoring.
LEGACY_WEIGHTS = {"VERIFIED_MISMATCH": 15, "MISSING_INFORMATION": 10, "UNUSUAL_ASSUMPTION_CHANGE": 8, "UNRESOLVED_INCONSISTENCY": 5}


def session_observations(obs: DataFrame, documents: DataFrame) -> DataFrame:
    """Observations with their documents' names and categories; missing confidences count as 1."""
    about = documents.select("session_id", "document_id", "filename", "document_category")
    sure = {c: F.coalesce(F.col(c), F.lit(1.0)) for c in ("conf_value", "conf_label", "conf_period", "conf_parse")}
    return obs.drop("filename", "document_category").join(about, ["session_id", "document_id"]).withColumns(sure)


def ordered_observations(obs: DataFrame, session_id: str) -> DataFrame:
    return obs.where(F.col("session_id") == session_id).orderBy("metric_key", "period_key", "ordinal")


def ordered_findings(f: DataFrame, session_id: str) -> DataFrame:
    return f.where(F.col("session_id") == session_id).orderBy(F.desc("severity"), "ref_code")


def lookup(table: DataFrame, column: str, value: str) -> DataFrame:
    """The rows of a table with a value, latest first if it tells when they were made."""
    got = table.where(F.col(column) == value)
    return got.orderBy(F.desc("created_at")) if "created_at" in table.columns else got


def most_common(df: DataFrame, by: Sequence[str], value: str, order: str) -> DataFrame:
    """The value that each group has most often, whatever its case, as first written; of ties the first seen."""
    g = df.where(F.col(value).isNotNull()).groupBy(*by, F.lower(value).alias("__low")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(order, value)).alias("first"))
    w = W.partitionBy(*by).orderBy(F.desc("n"), F.col(f"first.{order}"))
    return g.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").select(*by, F.col(f"first.{value}").alias(value), "n")


def count_by(df: DataFrame, by: Sequence[str], value: Column) -> DataFrame:
    """by and counts: how often each value comes in a group, nulls as unknown."""
    g = df.groupBy(*by, F.coalesce(value.cast("string"), F.lit("unknown")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("counts"))


def named_metric() -> Column:
    """A metric with its subject in brackets, if it has one."""
    return F.when(F.col("subject").isNotNull() & ~F.col("subject").isin("-", ""), F.concat("metric_key", F.lit(" ("), "subject", F.lit(")"))).otherwise(F.col("metric_key"))


def comparison_matrix(obs: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Each metric (with its subject) and period: the last value of each category, and how many documents report it."""
    named = named_metric()
    last = [F.max_by("value_base", F.when(F.col("document_category") == c, F.col("ordinal"))).alias(c) for c in categories]
    return obs.where(comparable(F.col("period_key"))).groupBy("session_id", named.alias("metric_key"), "period_key").agg(*last, F.count_distinct("document_id").alias("source_count"))


def comparison_section(obs: DataFrame) -> DataFrame:
    """(session_id, metric_key, period_key, kinds, values, source_count): as comparison_matrix(), whatever kinds a session has.

    kinds: the session's kinds of documents, in order; values: the last value of each kind that states one.
    """
    by = ["session_id", "metric_key", "period_key"]
    kinds = obs.groupBy("session_id").agg(F.array_sort(F.collect_set("document_category")).alias("kinds"))
    o = obs.where(comparable(F.col("period_key"))).select("session_id", named_metric().alias("metric_key"), "period_key", "document_category", "document_id", "value_base", "ordinal")
    last = o.groupBy(*by, "document_category").agg(F.max_by("value_base", "ordinal").alias("v"), F.collect_set("document_id").alias("docs"))
    kind = F.when(F.col("document_category").isNotNull(), F.struct("document_category", "v"))
    rows = last.groupBy(*by).agg(F.map_from_entries(F.collect_list(kind)).alias("values"), F.size(F.array_distinct(F.flatten(F.collect_list("docs")))).cast("long").alias("source_count"))
    return rows.join(kinds, "session_id").select(*by, "kinds", "values", "source_count")


def evidence_matrix(evidence: DataFrame, documents: int = 5, rows: int = 10) -> DataFrame:
    """(session_id, row, column, metric_key, period_key, filename, value): a view's first documents and rows, a report's size.

    evidence: session_id, metric_key, period_key, filename, value_base, ordinal.
    """
    first = evidence.groupBy("session_id", "metric_key", "period_key", "filename").agg(F.max_by("value_base", "ordinal").alias("value"), F.min("ordinal").alias("ordinal"))
    column = first.groupBy("session_id", "filename").agg(F.min("ordinal").alias("o")).withColumn("column", F.row_number().over(W.partitionBy("session_id").orderBy("o"))).where(F.col("column") <= documents)
    row = first.groupBy("session_id", "metric_key", "period_key").agg(F.min("ordinal").alias("o")).withColumn("row", F.row_number().over(W.partitionBy("session_id").orderBy("o"))).where(F.col("row") <= rows)
    return first.join(column.drop("o"), ["session_id", "filename"]).join(row.drop("o"), ["session_id", "metric_key", "period_key"]).select("session_id", "row", "column", "metric_key", "period_key", "filename", "value")


def filtered(f: DataFrame, band: str | None = None, pillar: str | None = None) -> DataFrame:
    """Problems of a severity band or pillar."""
    out = f.where("classification <> 'VERIFIED_CONSISTENT'")
    out = out if band is None else out.where(F.col("severity_band") == band)
    return out if pillar is None else out.where(F.col("pillar") == pillar)


def band_counts(f: DataFrame) -> DataFrame:
    """How many problems each session has of each severity band and pillar."""
    return filtered(f).groupBy("session_id", "severity_band", "pillar").agg(F.count(F.lit(1)).alias("n"))


def history(reports: DataFrame) -> DataFrame:
    """The columns of each session's report that a list of sessions shows, latest first if it tells when."""
    shown = [c for c in ("session_id", "company_name", "status", "score", "band", "ceiling", "verified_mismatch", "unresolved_inconsistency", "missing_information", "unusual_assumption_change", "verified_consistent", "rulepack_version", "created_at") if c in reports.columns]
    rows = reports.select(*shown)
    return rows.orderBy(F.desc("created_at"), "session_id") if "created_at" in shown else rows


def stale(reports: DataFrame, pack: RulePack = RulePack()) -> DataFrame:
    """(session_id, stale): whether a report was made by another version of the rule pack."""
    return reports.select("session_id", (~F.col("rulepack_version").eqNullSafe(pack.version)).alias("stale"))


def tolerance_text() -> Column:
    return F.coalesce(F.concat(plain_number(F.col("tolerance_pct"), 4), F.lit("%")), F.concat(plain_number(F.col("tolerance_abs"), 4), F.lit("pp")), F.lit(""))


def finding_rows(f: DataFrame) -> DataFrame:
    """The findings of a report with the columns of its table."""
    files = F.array_join(F.array_distinct(F.transform("obs", lambda o: o["filename"])), "; ")
    return f.select(
        "session_id", "ref_code", "classification", "severity", "severity_band", "pillar", "metric_key", "period_key", F.coalesce(F.col("words")["expression"], F.lit("")).alias("check"),
        F.coalesce(F.col("words")["substituted"], F.lit("")).alias("arithmetic"), rounded(F.col("delta_pct"), 2).alias("gap_pct"), tolerance_text().alias("tolerance"), files.alias("documents"),
        F.coalesce("narrative", F.lit("")).alias("explanation"), F.coalesce("follow_up_question", F.lit("")).alias("follow_up_question"),
    )


def finding_section(f: DataFrame) -> DataFrame:
    """finding_rows(), most severe first in each session."""
    return finding_rows(f).orderBy("session_id", F.desc("severity"), "ref_code")


def figure_rows(obs: DataFrame) -> DataFrame:
    """The figures of a report: each observation with its combined confidence."""
    sure = F.coalesce("conf_value", F.lit(1.0)) * F.coalesce("conf_label", F.lit(1.0)) * F.coalesce("conf_period", F.lit(1.0)) * F.coalesce("conf_parse", F.lit(1.0))
    return obs.select("session_id", "filename", "document_category", "metric_key", "value_base", "currency", "unit", "period_key", "subject", "quote", rounded(sure, 3).alias("confidence"))


def figure_section(obs: DataFrame) -> DataFrame:
    """figure_rows() in order of metric, period and document."""
    return figure_rows(obs).orderBy("session_id", "metric_key", "period_key", "filename")


def legacy_matrix(metrics: DataFrame) -> DataFrame:
    """(session_id, metric_key, period_key, categories, variance_pct, status): the first figure of each category compared.

    metrics: session_id, metric_key, period_key, document_category, value, currency, ordinal.
    """
    by = ["session_id", "metric_key", "period_key"]
    first = metrics.groupBy(*by, "document_category").agg(F.min_by(F.struct("value", "currency"), "ordinal").alias("f"))
    g = first.groupBy(*by).agg(F.count(F.lit(1)).alias("categories"), F.min("f.value").alias("low"), F.max("f.value").alias("high"), F.count_distinct("f.currency").alias("currencies"))
    variance = F.when((F.col("categories") > 1) & (F.col("currencies") <= 1) & (F.col("low") != 0), (F.col("high") - F.col("low")) / F.abs("low") * 100).otherwise(0.0)
    told = F.when(variance <= 1, "VERIFIED_CONSISTENT").when(variance <= 2, "UNRESOLVED_INCONSISTENCY").otherwise("VERIFIED_MISMATCH")
    status = F.when((F.col("categories") == 1) | ((F.col("currencies") <= 1) & ((F.col("low") == 0) | F.col("low").isNull())), "PARTIAL_COVERAGE").when(F.col("currencies") > 1, "UNRESOLVED_INCONSISTENCY").otherwise(told)
    return g.select(*by, "categories", rounded(variance, 4).alias("variance_pct"), status.alias("status"))


def legacy_claims(metrics: DataFrame) -> DataFrame:
    """Deck figures whose metric and period no other document has, coded in their order within a session."""
    other = metrics.where("document_category <> 'pitch_deck' or document_category is null").select("session_id", "metric_key", "period_key")
    lone = metrics.where("document_category = 'pitch_deck'").join(other, ["session_id", "metric_key", "period_key"], "left_anti")
    n = F.row_number().over(W.partitionBy("session_id").orderBy("ordinal")).cast("string")
    code = F.concat(F.lit("MISSING-CLAIM-"), F.lpad(n, F.greatest(F.length(n), F.lit(3)), F.lit("0")))
    return lone.withColumn("ref_code", code).select("session_id", "ref_code", "metric_key", "period_key", "value", F.lit("MISSING_INFORMATION").alias("classification"))


def legacy_score(counts: DataFrame) -> DataFrame:
    """(session_id, score) from counts(session_id, mismatches, missing, unusual, inconsistencies, kinds)."""
    loss = sum((F.col(c) * w for c, w in zip(("mismatches", "missing", "unusual", "inconsistencies"), LEGACY_WEIGHTS.values(), strict=True)), F.lit(0))
    cover = F.floor((1 - F.least(F.col("kinds") / 5.0, F.lit(1.0))) * 20 + 0.5)
    return counts.select("session_id", F.greatest(F.lit(0), 100 - loss - cover).cast("long").alias("score"))


def legacy_questions(findings: DataFrame, most: int = 10) -> DataFrame:
    """Each session's distinct questions by class weight, then order; at most so many, a report's length."""
    weight = F.coalesce(*[F.when(F.col("classification") == k, w) for k, w in LEGACY_WEIGHTS.items()], F.lit(0))
    asked = findings.where("question is not null and question <> ''").withColumn("__w", weight)
    first = asked.withColumn("__n", F.row_number().over(W.partitionBy("session_id", "question").orderBy(F.desc("__w"), "ordinal"))).where("__n = 1")
    ranked = first.withColumn("priority", F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("__w"), "ordinal")))
    return ranked.where(F.col("priority") <= most).select("session_id", "priority", "question", "classification", F.coalesce("ref_code", F.lit("N/A")).alias("ref_code"))


def json_answer(text: Column) -> Column:
    """The JSON object of a model's answer: in a fence, else from the first to the last brace outside its thinking.

    Null where neither is an object.
    """
    fenced = F.regexp_extract(text, r"(?s)```json\n(.*?)\n```", 1)
    bare = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    braced = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    valid = lambda c: F.when((c != "") & F.get_json_object(c, "$").isNotNull(), F.get_json_object(c, "$"))
    return F.coalesce(valid(fenced), valid(braced))

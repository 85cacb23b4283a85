"""What a session's documents must be before a check means anything, and warnings on what they gave."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.plans.rulepack import LEAST_DOCUMENTS, LEAST_KINDS

#: A document of which a larger share of figures was dropped is warned of.
MOST_DROPPED = 0.4


def input_gate(sessions: DataFrame, documents: DataFrame) -> DataFrame:
    """(session_id, ok, code) of every session: no_files, too_few_documents or too_few_document_types, else ok."""
    kind = F.when(~F.col("document_category").isin("unknown", ""), F.col("document_category"))
    seen = documents.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(kind).alias("kinds"))
    n = F.coalesce("n", F.lit(0))
    code = F.when(n == 0, "no_files").when(n < LEAST_DOCUMENTS, "too_few_documents").when(F.coalesce("kinds", F.lit(0)) < LEAST_KINDS, "too_few_document_types")
    return sessions.select("session_id").distinct().join(seen, "session_id", "left").select("session_id", code.isNull().alias("ok"), code.alias("code"))


def company_mismatch(documents: DataFrame) -> DataFrame:
    """(session_id, names) of sessions in which some company name neither contains another nor is in one.

    A session has as many names as documents at most, so its names are compared within one row.
    """
    names = documents.select("session_id", F.lower(F.trim("company_name")).alias("name")).where("name <> ''").distinct()
    g = names.groupBy("session_id").agg(F.array_sort(F.collect_list("name")).alias("names")).where("size(names) > 1")
    related = lambda a: F.exists("names", lambda b: (a != b) & (F.contains(a, b) | F.contains(b, a)))
    return g.where(~F.forall("names", related))


def low_extraction(documents: DataFrame, records: DataFrame) -> DataFrame:
    """(session_id, document_id, kept, dropped, code) of documents with no figures, or with too many dropped.

    records: canonical()'s rows, of which dropped names why one doesn't count.
    """
    by = ["session_id", "document_id"]
    g = records.groupBy(*by).agg(F.count_if(F.col("dropped").isNull()).alias("kept"), F.count_if(F.col("dropped").isNotNull()).alias("dropped"))
    d = documents.select(*by).distinct().join(g, by, "left").na.fill(0, ["kept", "dropped"])
    code = F.when(F.col("kept") == 0, "no_figures_extracted").when(F.col("dropped") / (F.col("dropped") + F.col("kept")) > MOST_DROPPED, "high_discard_rate")
    return d.withColumn("code", code).where("code is not null")

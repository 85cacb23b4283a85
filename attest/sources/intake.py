"""A reader's answers, chunk by chunk, to raw records; what can't be read is set aside with its reason.

answers: session_id, document_id, chunk, answer (a JSON object whose observations, or else metrics, are an
array of records). Every answer and every record is in exactly one place: among the records, or among the
failures with a reason and its text. One bad chunk, or record, doesn't cost a document the rest; a document
of which every chunk failed and no record was read has failed.

Reasons: no_answer (null or blank), no_object (broken, cut off, or no JSON object), no_array (the records
are no array), no_record (an element is no object). An object without records is no failure.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.operators.serving import most_common
from attest.sources.session import once

#: All as text: canonical() reads figures and confidences itself.
RECORD = "raw_label string, metric_key string, value_raw string, value string, period string, period_type string, basis string, source_quote string, source_cell string, confidence string, company_name string"
_CHUNK = ("session_id", "document_id", "chunk")
_MODE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"}


@dataclass(frozen=True)
class Intake:
    """records and failures; documents has a row for each document with its counts, which add up."""

    records: DataFrame
    failures: DataFrame
    documents: DataFrame


def _object(text: Column, schema: str) -> Column:
    """The object, null if the text is none or is broken."""
    got = F.from_json(text, f"{schema}, bad string", _MODE)
    return F.when(F.ltrim(text).startswith("{") & got["bad"].isNull(), got)


def intake(answers: DataFrame) -> Intake:
    """Reads all answers; they are parsed once."""
    a = answers.select(*_CHUNK, "answer").withColumn("o", _object(F.col("answer"), "observations string, metrics string"))
    given = lambda c: F.when(~c.isin("", "null", "false", "0"), c)  # noqa: E731  what counts as given
    a = a.withColumn("list", F.coalesce(given(F.col("o.observations")), given(F.col("o.metrics")), F.lit("[]")))
    elements = F.from_json("list", "array<string>")
    reason = (
        F.when(F.trim(F.coalesce("answer", F.lit(""))) == "", "no_answer")
        .when(F.col("o").isNull(), "no_object")
        .when(~F.ltrim("list").startswith("[") | elements.isNull(), "no_array")
    )
    a = once(a.select(*_CHUNK, "answer", reason.alias("reason"), elements.alias("elements")))
    each = a.where("reason is null").select(*_CHUNK, F.posexplode("elements").alias("place", "text")).withColumn("r", _object(F.col("text"), RECORD))
    records = each.where("r is not null").select(*_CHUNK, "place", *[F.col(f"r.{c.split()[0]}").alias(c.split()[0]) for c in RECORD.split(", ")])
    broken = each.where("r is null").select(*_CHUNK, F.col("place").cast("int").alias("place"), F.lit("no_record").alias("reason"), F.col("text").alias("content"))
    failures = a.where("reason is not null").select(*_CHUNK, F.lit(None).cast("int").alias("place"), "reason", F.col("answer").alias("content")).unionByName(broken)

    by = ["session_id", "document_id"]
    chunks = a.groupBy(*by).agg(F.count(F.lit(1)).alias("chunks"), F.count("reason").alias("failed_chunks"))
    counts = each.groupBy(*by).agg(F.count("r").alias("records"), F.count_if(F.col("r").isNull()).alias("failed_records"))
    named = records.withColumn("company_name", F.nullif(F.trim("company_name"), F.lit(""))).withColumn("at", F.struct("chunk", "place"))
    company = most_common(named, by, "company_name", "at").drop("n")
    d = chunks.join(counts, by, "left").join(company, by, "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("records", "failed_records")})
    return Intake(records, failures, d.withColumn("failed", (F.col("records") == 0) & (F.col("failed_chunks") == F.col("chunks"))))

"""Answers that are whole, broken, cut off, nested or empty: each record and answer in one place."""

from attest.operators.canonicalize import canonical
from attest.sources.intake import intake

ANSWERS = [
    ("s", "a", 0, '{"observations": [{"raw_label": "Revenue", "value_raw": "Rs 5 Cr", "value": 5, "period": "FY25", "source_quote": "q", "confidence": 0.9, "company_name": "Acme"}, 7, {"raw_label": "x", "extra": {"deep": [1, {"y": 2}]}, "company_name": " acme "}]}'),
    ("s", "a", 1, '{"observations": [{"raw_label": "cut off'),
    ("s", "a", 2, '{"observations": null, "metrics": [{"raw_label": "ARR", "value": "1e3", "company_name": "Other"}]}'),
    ("s", "b", 0, None),
    ("s", "b", 1, " "),
    ("s", "b", 2, "[1, 2]"),
    ("s", "c", 0, '{"observations": {"raw_label": "no list"}}'),
    ("s", "c", 1, "{}"),
    ("t", "d", 0, '{"observations": []}'),
    (None, "e", 0, "no json"),
]


def test_every_answer_has_one_place(spark):
    got = intake(spark.createDataFrame(ANSWERS, "session_id string, document_id string, chunk int, answer string").repartition(3))
    assert {(r.document_id, r.chunk, r.place, r.raw_label) for r in got.records.collect()} == {("a", 0, 0, "Revenue"), ("a", 0, 2, "x"), ("a", 2, 0, "ARR")}
    assert {(r.document_id, r.chunk, r.place, r.reason) for r in got.failures.collect()} == {("a", 0, 1, "no_record"), ("a", 1, None, "no_object"), ("b", 0, None, "no_answer"), ("b", 1, None, "no_answer"), ("b", 2, None, "no_object"), ("c", 0, None, "no_array"), ("e", 0, None, "no_object")}
    d = {r.document_id: (r.chunks, r.failed_chunks, r.records, r.failed_records, r.company_name, r.failed) for r in got.documents.collect()}
    assert d == {"a": (3, 1, 3, 1, "Acme", False), "b": (3, 3, 0, 0, None, True), "c": (2, 1, 0, 0, None, False), "d": (1, 0, 0, 0, None, False), "e": (1, 1, 0, 0, None, True)}
    empty = intake(got.failures.limit(0).selectExpr("session_id", "document_id", "chunk", "content as answer"))
    assert empty.records.count() == empty.failures.count() == empty.documents.count() == 0


def test_records_go_on(spark):
    got = intake(spark.createDataFrame(ANSWERS[:1], "session_id string, document_id string, chunk int, answer string"))
    docs = spark.createDataFrame([("s", "a", "a.pdf", "mis", ".pdf", None)], "session_id string, document_id string, filename string, document_category string, file_type string, period_hint string")
    raw = got.records.withColumn("ordinal", got.records["chunk"] * 1000 + got.records["place"])
    c = {r.raw_label: r for r in canonical(raw, docs, [("revenue", "revenue")]).collect()}
    assert (c["Revenue"].value_base, c["Revenue"].dropped, c["x"].dropped) == (5e7, None, "missing_source_quote")

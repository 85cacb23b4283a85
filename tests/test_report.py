"""Explanations, what-if, guards, sinks and sheets with known results."""

import csv
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from attest import sinks
from attest.functions.period import human_period
from attest.functions.text import conversion_text, number_of, plain_number, points_text, scale_of, value_of
from attest.operators import adjudicate, explain, guards, serving
from attest.operators.facts import parsed_rates
from attest.operators.findings import evidence, findings_of, readiness, verify
from attest.sources import sheets
from tests.test_verify import observed, rates  # noqa: F401


@pytest.fixture(scope="module")
def all_checked(observed, rates):  # noqa: F811
    n, f = verify(observed, rates)
    return n, explain.explained(f).persist()


def test_every_problem_is_told(all_checked):
    f = all_checked[1]
    assert f.where("narrative is null or narrative = ''").count() == 0
    assert f.where("(follow_up_question is null) <> (classification = 'VERIFIED_CONSISTENT')").count() == 0
    told = {(r.session_id, r.rule_id): r for r in f.collect()}
    assert told["deck_vs_auditor", "R1.cross_source.revenue"].narrative.startswith("Documents differ (Revenue, FY2024-25). highest: D.pdf Rs 5,20,00,000; lowest: A.pdf Rs 3,20,00,000; gap: 62.5%; tolerance: 2%")
    r2 = told["identity", "R2.gross_profit"]
    assert r2.words["expression"] == "revenue - cogs = gross_profit"
    assert r2.words["substituted"] == "Rs 5,20,00,000 - Rs 3,10,00,000 = Rs 2,10,00,000   [document states Rs 2,40,00,000]"
    assert (r2.words["culprit"], r2.figures["culprit_needs"]) == ("revenue", 55e6)
    assert "gap in points: 6 percentage points" in told["shares", "R7.ownership_sum"].narrative
    assert {r.topic for r in told.values()} <= set(explain.HEADINGS) and len({r.topic for r in told.values()}) > 8
    assert told["year", "R3.month_to_fy"].figures["components"] == 12
    assert "[converted using USD_INR @ 83.2]" in told["dollars", "R1.cross_source.revenue"].narrative


def test_questions_and_summary(all_checked):
    n, f = all_checked
    q = explain.questions(f)
    assert q.where("priority > 12").count() == 0 and q.groupBy("session_id", "priority").count().where("count > 1").count() == 0
    s = {r.session_id: r.summary for r in explain.summaries(n, f).collect()}
    assert "Figures: 2 from 1 kinds of documents, 0 in two or more." in s["single"]
    assert "verified mismatch: 1" in s["deck_vs_auditor"]


def test_narration_is_only_prose(spark, all_checked):
    f = all_checked[1].where("session_id = 'deck_vs_auditor'")
    code = f.first().ref_code
    texts = spark.createDataFrame([("deck_vs_auditor", code, "A longer text about the two figures."), ("deck_vs_auditor", "VM-R1-999", "A text for a finding that is not there."), ("deck_vs_auditor", code, "short")], "session_id string, ref_code string, narrative string")
    got = explain.narrated(f, texts)
    assert got.count() == f.count() and got.where("narrative_source = 'model'").count() == 1
    same = [c for c in f.columns if c not in ("narrative", "narrative_source", "words", "figures", "obs", "statements")]
    assert got.select(same).exceptAll(f.select(same)).count() == 0


def test_adjudicate_in_order(observed, rates):  # noqa: F811
    one = observed.where("session_id = 'deck_vs_auditor'")
    before = verify(one, rates)
    o = adjudicate.Override
    out = adjudicate.adjudicate(one, rates, [o("tolerance", metric_key="revenue"), o("authoritative_source", document_id="A"), o("accept_explanation", "deck_vs_auditor", finding_ref="REV-R1-001", note="old deck"), o("other")])
    assert [t.startswith("ignored") for _, t in out.trail] == [True, False, False, True]
    got = {r.ref_code: r for r in out.findings.collect()}
    assert got["REV-R1-001"].accepted and got["REV-R1-001"].severity == 0 and got["REV-R1-001"].original_severity > 0 and got["REV-R1-001"].note == "old deck"
    moved = adjudicate.score_diff(readiness(*before), out.score).first()
    assert moved.after_score >= moved.before_score
    assert one.where("document_id = 'D'").first().conf_value == 1.0


def test_rates_override(observed, rates):  # noqa: F811
    one = observed.where("session_id = 'dollars'")
    out = adjudicate.adjudicate(one, rates, [adjudicate.Override("fx_rate", rates={"USD": 51.2})])
    assert out.findings.where("rule_id = 'R1.cross_source.revenue'").first().classification == "VERIFIED_CONSISTENT"


def test_evidence(observed, rates, all_checked):  # noqa: F811
    e = evidence(all_checked[1], observed, rates).where("session_id = 'deck_vs_auditor'").collect()
    assert {(r.filename, r.value_base, r.quote) for r in e} >= {("D.pdf", 52e6, "q"), ("A.pdf", 32e6, "q")}


def test_guards(spark):
    d = spark.createDataFrame([("a", "deck", "Acme"), ("a", "mis", "Acme Ltd"), ("b", "mis", "Acme"), ("b", "mis", "Other"), ("c", "unknown", None)], "session_id string, document_category string, company_name string")
    s = spark.createDataFrame([(x,) for x in "abcd"], "session_id string")
    assert {r.session_id: r.code for r in guards.input_gate(s, d).collect()} == {"a": None, "b": "too_few_document_types", "c": "too_few_documents", "d": "no_files"}
    assert [r.session_id for r in guards.company_mismatch(d).collect()] == ["b"]


def test_parsed_rates(spark):
    rows = [("a", '{"USD_INR": 83.2, "EUR": "90", "source": "x", "GBP": 0, "SGD": "no"}'), ("b", "[1]"), ("c", "no"), ("d", None)]
    got = {(r.session_id, r.currency): r.rate for r in parsed_rates(spark.createDataFrame(rows, "session_id string, fx_rates string")).collect()}
    assert got == {("a", "USD"): 83.2, ("a", "EUR"): 90.0}


def test_sinks(spark, all_checked, observed, tmp_path):  # noqa: F811
    n, f = all_checked
    one = f.where("session_id in ('identity', 'shares')").drop("words", "figures", "obs", "statements")
    sinks.append(one, f"{tmp_path}/findings")
    sinks.replace(one.where("session_id = 'shares'").limit(1), f"{tmp_path}/findings")
    kept = {r.session_id: r["count"] for r in spark.read.parquet(f"{tmp_path}/findings").groupBy("session_id").count().collect()}
    assert kept["shares"] == 1 and kept["identity"] == f.where("session_id = 'identity'").count()
    reports = sinks.reports(n, f)
    assert reports.count() == n.select("session_id").distinct().count()
    changed = sinks.with_changes(reports.select("session_id", "status"), spark.createDataFrame([("identity", "failed")], "session_id string, status string"), ["status"])
    assert {r.session_id for r in changed.where("status = 'failed'").collect()} == {"identity"}
    out = io.StringIO()
    sinks.csv_report(out, "identity", reports, f, observed)
    rows = list(csv.reader(io.StringIO(out.getvalue().removeprefix("﻿"))))
    assert out.getvalue()[0] == "﻿" and ["FINDINGS"] in rows and ["EXTRACTED FIGURES"] in rows
    assert any(r and r[0].startswith("GP-R2-") for r in rows)
    assert not serving.stale(reports).where("stale").count()


def test_serving(spark):
    m = spark.createDataFrame([("s", "revenue", "FY", "pitch_deck", 10.0, "INR", 0), ("s", "revenue", "FY", "mis", 10.15, "INR", 1), ("s", "arr", "FY", "pitch_deck", 5.0, "INR", 2), ("s", "cac", "FY", "pitch_deck", 5.0, "USD", 3), ("s", "cac", "FY", "mis", 5.0, "INR", 4)], "session_id string, metric_key string, period_key string, document_category string, value double, currency string, ordinal long")
    assert {r.metric_key: r.status for r in serving.legacy_matrix(m).collect()} == {"revenue": "UNRESOLVED_INCONSISTENCY", "arr": "PARTIAL_COVERAGE", "cac": "UNRESOLVED_INCONSISTENCY"}
    assert [(r.ref_code, r.metric_key) for r in serving.legacy_claims(m).collect()] == [("MISSING-CLAIM-001", "arr")]
    q = spark.createDataFrame([("s", "b?", "UNRESOLVED_INCONSISTENCY", None, 0), ("s", "a?", "VERIFIED_MISMATCH", "VM-1", 1), ("s", "a?", "MISSING_INFORMATION", None, 2)], "session_id string, question string, classification string, ref_code string, ordinal int")
    assert [(r.priority, r.question, r.ref_code) for r in serving.legacy_questions(q).orderBy("priority").collect()] == [(1, "a?", "VM-1"), (2, "b?", "N/A")]


def test_csv_and_xlsx(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Metric,"FY25\nactual"\n\nRevenue,"1|2"\n')
    got = sheets.sheet_text(sheets.csv_cells(spark, f"{tmp_path}/a.csv")).first().text
    assert got == "## Sheet: Sheet1\n\n| Cell | Metric | FY25 actual |\n| --- | --- | --- |\n| A3 | Revenue | 1\\|2 |\n\n"
    x, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{x}" xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{x}"><si><t>Margin</t></si><si><t>Day</t></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{x}"><cellXfs><xf numFmtId="0"/><xf numFmtId="9"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{x}"><sheetData><row r="1"><c r="B1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="4"><c r="B4" s="1"><v>0.62</v></c><c r="C4" s="2"><v>45000</v></c></row></sheetData></worksheet>')
    got = sheets.sheet_text(sheets.xlsx_cells(spark, f"{tmp_path}/b.xlsx")).first().text
    assert got == "## Sheet: S\n\n| Cell | Margin | Day |\n| --- | --- | --- |\n| B4 | 62% | 2023-03-15 |\n\n"


def test_chunks(spark):
    texts = ["", None, "short", "\n".join(["a" * 30] * 4 + ["Page 2"] + ["b" * 30] * 9)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.c for r in d.select("i", sheets.chunks(F.col("t"), 100).alias("c")).collect()}
    assert (got[0], got[1], got[2]) == ([], [], ["short"])
    assert "".join(got[3]) == texts[3] + "\n" and got[3][1].startswith("Page 2")


def test_glued_scales_and_signs(spark):
    want = {"₹5.2crore": (1e7, 5.2), "50lakh": (1e5, 50.0), "10million": (1e6, 10.0), "in place of 5": (1.0, 5.0), "Rs-5": (1.0, 5.0), "note-4": (1.0, 4.0), "5-": (1.0, -5.0), "(1.2.3)": (1.0, -1.23), "lac 5": (1e5, 5.0)}
    d = spark.createDataFrame([(k,) for k in want], "r string")
    assert {x.r: (x.s, x.n) for x in d.select("r", scale_of(F.col("r")).alias("s"), number_of(F.col("r")).alias("n")).collect()} == want
    v = spark.createDataFrame([("Rs 5",)], "r string").select(value_of(F.col("r"), F.lit(None).cast("double"), F.lit("pct")).alias("v")).first().v
    assert (v.conf, v.reason) == (0.5, "declared_percentage_but_value_is_currency")


def test_words_for_numbers(spark):
    one = spark.range(1).select(
        plain_number(F.lit(37.5), 2), plain_number(F.lit(38.0), 2), plain_number(F.lit(-0.125), 2), points_text(F.lit(1.0)), points_text(F.lit(7.0)), human_period(F.lit("M03-FY2024-25")), human_period(F.lit("REL-Y1")), human_period(F.lit("Q3-FY2024-25")),
        human_period(F.lit("UNKNOWN")), human_period(F.lit(None).cast("string")), conversion_text(F.lit(100.0), F.lit("USD"), F.lit(83.2), F.lit(8320.0)),
    ).first()
    assert list(one) == ["37.5", "38", "-0.12", "1 percentage point", "7 percentage points", "March 2025", "projected year 1", "Q3 FY2024-25", "an unstated period", "an unstated period", "$100 x 83.2 = Rs 8,320"]


def test_nodes_are_scanned_once(observed, rates):  # noqa: F811
    n, f = verify(observed, rates)
    plan = f._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in plan and "period_raw" not in plan and "LogicalRDD" not in plan.split("CreateDataFrame")[0]  # nodes are read, not computed again
    assert n._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
    assert findings_of(n).count() == f.count()

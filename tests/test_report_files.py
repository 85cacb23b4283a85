"""Reports as CSV files: one for each session, written by the executors."""

import csv
import io

import pytest
from pyspark.sql import functions as F

from attest import sinks
from attest.operators import rules
from attest.operators.explain import explained
from attest.operators.findings import verify
from attest.sources.session import once
from tests.test_verify import observed, rates  # noqa: F401


@pytest.fixture(scope="module")
def made(observed, rates):  # noqa: F811
    n, f = verify(observed, rates, rules=(rules.cross_source, rules.plausible))
    f = once(explained(f))
    return once(sinks.reports(n, f)), f


def parsed(text):
    assert text.startswith("﻿") and text.endswith("\r\n")
    return list(csv.reader(io.StringIO(text.removeprefix("﻿"), newline="")))


def section(rows, title):
    at = rows.index([title])
    end = rows.index([], at) if [] in rows[at:] else len(rows)
    return rows[at + 1], rows[at + 2 : end]


def test_one_file_for_each_session(spark, made, observed, tmp_path):  # noqa: F811
    report, f = made
    odd = observed.withColumn("quote", F.when(F.col("session_id") == "marginal", F.lit('says "33,0"\r\nhere')).otherwise(F.col("quote")))
    path = f"file://{tmp_path}/reports"
    sinks.csv_reports(report, f, odd, path)
    sessions = sorted(r.session_id for r in report.select("session_id").collect())
    assert sorted(p.name for p in (tmp_path / "reports").iterdir() if p.suffix == ".csv") == [f"{s}.csv" for s in sessions]
    assert not [p for p in (tmp_path / "reports").iterdir() if p.is_dir()]
    figures = {}
    for r in observed.collect():
        figures.setdefault(r.session_id, []).append(r)
    codes = {}
    for r in f.orderBy(F.desc("severity"), "ref_code").collect():
        codes.setdefault(r.session_id, []).append(r.ref_code)
    for s in sessions:
        rows = parsed((tmp_path / "reports" / f"{s}.csv").read_bytes().decode())
        assert rows[:2] == [["Verification report"], ["Session", s]]
        assert len(section(rows, "SCORE BREAKDOWN")[1]) == 5
        names, found = section(rows, "FINDINGS")
        assert [r[names.index("ref_code")] for r in found] == codes.get(s, [])
        names, said = section(rows, "EXTRACTED FIGURES")
        want = sorted(r.value_base for r in figures[s] if r.value_base is not None)
        assert sorted(float(r[names.index("value_base")]) for r in said if r[names.index("value_base")]) == want and len(said) == len(figures[s])
        assert s != "marginal" or {r[names.index("quote")] for r in said} == {'says "33,0"\r\nhere'}
        if s == "marginal":
            assert section(rows, "COMPARISON MATRIX") == (["metric_key", "period_key", "financial_statements", "mis", "source_count"], [["revenue", "FY2024-25", "32000000", "33000000", "2"]])
        if s == "identity":
            assert [r[0] for r in section(rows, "COMPARISON MATRIX")[1]] == ["cogs", "gross_profit", "revenue"]
    out = io.StringIO()
    sinks.csv_report(out, "marginal", report, f, odd)
    assert out.getvalue() == (tmp_path / "reports" / "marginal.csv").read_bytes().decode()


def test_files_are_replaced_and_others_stay(spark, made, observed, tmp_path):  # noqa: F811
    report, f = made
    path = f"file://{tmp_path}/r"
    sinks.csv_reports(report.where("session_id in ('arr', 'heads')"), f, observed, path)
    before = (tmp_path / "r" / "heads.csv").read_bytes()
    sinks.csv_reports(report.where("session_id = 'arr'").withColumn("band", F.lit("changed")), f, observed, path)
    assert (tmp_path / "r" / "heads.csv").read_bytes() == before and b"Assessment,changed" in (tmp_path / "r" / "arr.csv").read_bytes()
    assert sorted(p.name for p in (tmp_path / "r").iterdir() if p.suffix == ".csv") == ["arr.csv", "heads.csv"]


def test_a_session_without_findings_and_many_in_one_task(spark, made, observed, tmp_path):  # noqa: F811
    report, f = made
    copies = F.explode(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.concat(F.lit("n/"), i.cast("string"))))
    many = lambda d: d.where("session_id = 'year'").withColumn("session_id", copies)
    sinks.csv_reports(many(report), f.limit(0), many(observed), f"file://{tmp_path}/m")
    texts = {p.name: p.read_bytes().decode() for p in (tmp_path / "m").iterdir() if p.suffix == ".csv"}
    assert len(texts) == 40 and all(name.startswith("n%2F") for name in texts)
    for t in texts.values():
        rows = parsed(t)
        assert section(rows, "FINDINGS")[1] == [] and len(section(rows, "EXTRACTED FIGURES")[1]) == 13
        assert [r[1] for r in section(rows, "COMPARISON MATRIX")[1]] == sorted(r[1] for r in section(rows, "COMPARISON MATRIX")[1])

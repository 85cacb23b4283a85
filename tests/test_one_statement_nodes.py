"""Nodes whose documents say one thing each need no search of their cells, and come out as any others."""

from attest.operators.facts import _folded, _ranged, cells
from attest.plans.rulepack import RulePack
from tests.test_hot_nodes import COLUMNS, row


def test_documents_of_one_cell(spark):
    rows = [
        row(0, "a", "deck", 10.0), row(1, "a", "fs", 12.0, 0.5), row(2, "b", "deck", None), row(3, "b", "fs", 4.0), row(4, "c", "deck", 7.0, currency="XXX"),
        row(5, "d", "deck", 1.0), row(6, "d", "fs", 1.0), row(7, "d", "fs", 9.0), row(8, "e", "fs", 3.0),
    ]
    c = cells(spark.createDataFrame(rows, COLUMNS), spark.createDataFrame([], "session_id string, currency string, rate double"))
    one = _folded(c, RulePack())
    assert "sum(n" in one._jdf.queryExecution().optimizedPlan().toString()
    got, want = ({r["session_id"]: r.asDict(recursive=True) for r in d.collect()} for d in (one, _ranged(c, RulePack()).select(*one.columns)))
    assert got == want and len(got) == 5

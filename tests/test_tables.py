"""Session tables: replaced as a whole or not at all, and looked up by one bucket."""

import pytest
from pyspark.sql import functions as F

from attest.tables import SessionTable


@pytest.fixture
def table(spark, tmp_path):
    t = SessionTable(spark, f"file://{tmp_path}/t", buckets=8)
    assert t.read() is None and t.lookup("s1") is None
    t.append(spark.range(60).select(F.concat(F.lit("s"), F.col("id") % 20).alias("session_id"), F.col("id").alias("v")))
    return t


def held(t):
    out = {}
    for r in t.read().collect():
        out.setdefault(r.session_id, []).append(r.v)
    return {k: sorted(v) for k, v in out.items()}


def test_append_replace_and_lookup(spark, table):
    before = held(table)
    assert before["s3"] == [3, 23, 43] and len(before) == 20
    table.replace(spark.createDataFrame([("s3", 1000), ("new", 7)], "session_id string, v long"))
    assert held(table) == before | {"s3": [1000], "new": [7]}
    table.append(spark.createDataFrame([("s3", 1)], "session_id string, v long"))
    assert [r.v for r in table.lookup("s3").orderBy("v").collect()] == [1, 1000]
    assert table.lookup("nobody") is None or table.lookup("nobody").count() == 0
    table.replace(spark.createDataFrame([], "session_id string, v long"), spark.createDataFrame([("new",), ("s4",)], "session_id string"))
    assert set(held(table)) == set(before) - {"s4"}


def test_lookup_opens_one_bucket(table):
    files = table.lookup("s5").inputFiles()
    assert len({f.rsplit("/", 2)[1] for f in files}) == 1 and len(table.read().inputFiles()) > len(files)
    assert "session_id,s5" in table.lookup("s5")._jdf.queryExecution().executedPlan().toString().replace("EqualTo(", "")


def test_a_change_that_fails_leaves_the_table(spark, table):
    before, versions = held(table), table.versions()
    bad = spark.createDataFrame([("s3", 5), ("s6", 0)], "session_id string, v long").withColumn("v", F.when(F.col("v") == 0, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="stop"):
        table.replace(bad)
    assert held(table) == before and table.versions() == versions
    with pytest.raises(ValueError, match="without session_id"):
        table.append(spark.createDataFrame([(None, 1)], "session_id string, v long"))
    table.replace(spark.createDataFrame([("s3", 5)], "session_id string, v long"))
    assert held(table) == before | {"s3": [5]}


def test_new_columns_and_vacuum(spark, table):
    before = held(table)
    table.replace(spark.createDataFrame([("s1", 5, "x")], "session_id string, v long, note string"))
    assert {(r.v, r.note) for r in table.lookup("s1").collect()} == {(5, "x")} and held(table) == before | {"s1": [5]}
    for i in range(3):
        table.replace(spark.createDataFrame([("s2", i)], "session_id string, v long"))
    table.vacuum()
    assert len(table.versions()) == 1 and held(table) == before | {"s1": [5], "s2": [2]}

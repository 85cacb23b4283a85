"""Reference codes past the width of their number."""

from pyspark.sql import functions as F

from attest.operators.findings import coded
from attest.starschema import ref_codes


def test_findings_past_the_width(spark):
    found = spark.range(1012).select(
        F.lit("s").alias("session_id"), F.lit("VERIFIED_MISMATCH").alias("classification"), F.lit("R1").alias("rule_class"), F.lit(1.0).alias("severity"), F.col("id").alias("ordinal"),
        F.lit("r").alias("rule_id"), F.lit("revenue").alias("metric_key"), F.lit("p").alias("period_key"), F.col("id").cast("string").alias("node_key"), F.lit("d").alias("document_id"), F.lit("FAIL").alias("result"),
    )
    got = {r.ordinal: r.ref_code for r in coded(found).collect()}
    assert got == {i: f"REV-R1-{i + 1:03d}" for i in range(1012)}


def test_bucket_past_the_width(spark, tmp_path):
    n = 100_012
    spark.range(n).select((F.col("id") * 100).alias("o_orderkey"), F.to_date(F.lit("2024-05-01")).alias("o_orderdate"), F.lit(10.0).alias("o_totalprice")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(n).select((F.col("id") * 100).alias("l_orderkey"), F.lit(10.0).alias("l_extendedprice")).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.o_orderkey: r.ref_code for r in ref_codes(spark, str(tmp_path)).collect()}
    assert got == {i * 100: f"OK-0-{i + 1:05d}" for i in range(n)}

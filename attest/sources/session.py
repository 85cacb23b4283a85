"""Makes the package importable in Spark's Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds this package to the session's Python files, once for each Spark application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        top = Path(__file__).resolve().parents[1]
        at = os.path.join(tempfile.mkdtemp(prefix="attest-"), "attest_package.zip")
        with zipfile.ZipFile(at, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        spark.sparkContext.addPyFile(at)
        _SHIPPED.add(app)
    return spark


def shared(spark: SparkSession) -> str:
    """A new folder's name in the folder that spark.checkpoint.dir names.

    Where the session names none, a local master gets a temporary folder; elsewhere that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="attest-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    return f"file://{path}" if path.startswith("/") else path


def once(df: DataFrame) -> DataFrame:
    """df computed once: written as a table in the shared folder, and read from there."""
    path = shared(df.sparkSession)
    df = df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "void"})
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Tables of sessions that can be looked up and replaced: observations, findings, reports.

A table has a fixed number of buckets, by a hash of the session; a bucket is a folder of Parquet files that
are sorted by session and have a Bloom filter on it. Which folder is a bucket's is told by the newest version
that is whole: a small table of (bucket, path), as wide as there are buckets. A change writes the buckets
that it touches beside the old ones, and then a version that names them; a version counts once Spark has
written its _SUCCESS mark, so a change that fails half-way leaves the table as it was. Two changes at the
same time want the same version's name, which the second finds taken.

Defined cases: rows without a session are an error; a table that has no version yet is empty and gets its
columns from the first change; columns that a change lacks or adds are null where they are missing; a
replacement by no rows of a session, if `sessions` names it, removes it; folders that no version names any
more stay until vacuum() removes them.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "bucket int, path string"
#: Versions are numbers of so many digits, so that their names sort.
_DIGITS = 12


@dataclass(frozen=True)
class SessionTable:
    """path: a folder that all executors share. buckets: fixed when the table is made; key: the session's column."""

    spark: SparkSession
    path: str
    buckets: int = 256
    key: str = "session_id"

    def _files(self):
        """(Hadoop's file system of the path, a function to its paths)."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path
        return at(self.path).getFileSystem(conf), at

    def versions(self) -> list[int]:
        """The whole versions, oldest first."""
        files, at = self._files()
        found = files.globStatus(at(f"{self.path}/versions/*/_SUCCESS")) or []
        return sorted(int(x.getPath().getParent().getName()) for x in found)

    def _next(self) -> int:
        """A number after all versions, those that were begun and never finished included."""
        files, at = self._files()
        return max([int(x.getPath().getName()) for x in files.globStatus(at(f"{self.path}/versions/*")) or []], default=0) + 1

    def _folders(self) -> dict[int, str]:
        """The folder of each bucket that has rows: as many as there are buckets at most."""
        last = self.versions()[-1:]
        return {r.bucket: r.path for r in self.spark.read.schema(VERSION).parquet(self._version(last[0])).collect()} if last else {}

    def _version(self, n: int) -> str:
        return f"{self.path}/versions/{n:0{_DIGITS}d}"

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def _read(self, folders: list[str]) -> DataFrame | None:
        return self.spark.read.option("mergeSchema", True).parquet(*folders) if folders else None

    def read(self) -> DataFrame | None:
        """The whole table; None if it has no rows yet."""
        return self._read(sorted(self._folders().values()))

    def lookup(self, session: str) -> DataFrame | None:
        """The rows of one session: one bucket is opened, and its row groups are chosen by sort order and Bloom filter."""
        bucket = self.spark.range(1).select(F.lit(session).alias(self.key)).select(self._bucket()).first()[0]
        got = self._read([p for b, p in self._folders().items() if b == bucket])
        return None if got is None else got.where(F.col(self.key) == session)

    def among(self, sessions: DataFrame) -> DataFrame | None:
        """The rows of the sessions that a table names: only their buckets are opened."""
        wanted = sessions.select(self.key).distinct()
        got = self._read(self._folders_of(wanted))
        return None if got is None else got.join(wanted, self.key, "left_semi")

    def _folders_of(self, sessions: DataFrame) -> list[str]:
        touched = {r[0] for r in sessions.select(self._bucket()).distinct().collect()}  # buckets, so of fixed number
        return [p for b, p in sorted(self._folders().items()) if b in touched]

    def since(self, seen: set[str]) -> tuple[DataFrame | None, DataFrame]:
        """(the rows of buckets whose folder is not among those seen, with their folder as `source`; all folders now).

        A bucket's folder changes with each change that touches it, so what is in a folder that was seen is as it was.
        """
        now = self._folders()
        folders = self.spark.createDataFrame(sorted(now.items()), VERSION).select(F.col("bucket").alias("__b"), F.col("path").alias("source"))
        got = self._read(sorted(p for p in now.values() if p not in seen))
        if got is not None:
            got = got.withColumn("__b", self._bucket()).join(folders, "__b").drop("__b")
        return got, folders.select("source")

    def append(self, rows: DataFrame) -> None:
        """Adds rows to those that their sessions have."""
        self._change(rows, None)

    def replace(self, rows: DataFrame, sessions: DataFrame | None = None) -> None:
        """Puts rows in the place of those of their sessions, and of those that `sessions` names; others stay."""
        gone = rows.select(self.key) if sessions is None else rows.select(self.key).unionByName(sessions.select(self.key))
        self._change(rows, gone.distinct())

    def _change(self, rows: DataFrame, gone: DataFrame | None) -> None:
        if not rows.where(F.col(self.key).isNull()).isEmpty():
            raise ValueError(f"rows without {self.key}")
        before, number = self._folders(), self._next()
        named = rows if gone is None else gone
        touched = {r[0] for r in named.select(self._bucket().alias("b")).distinct().collect()}  # buckets, so of fixed number
        old = self._read([p for b, p in sorted(before.items()) if b in touched])
        if old is not None:
            kept = old if gone is None else old.join(gone, self.key, "left_anti")
            rows = kept.unionByName(rows, allowMissingColumns=True)
        data = f"{self.path}/data/{number:0{_DIGITS}d}-{uuid.uuid4().hex}"
        laid = rows.withColumn("__bucket", self._bucket()).repartition("__bucket").sortWithinPartitions("__bucket", self.key)
        laid.write.option(f"parquet.bloom.filter.enabled#{self.key}", True).partitionBy("__bucket").parquet(data)
        files, at = self._files()
        made = {b: f"{data}/__bucket={b}" for b in touched if files.exists(at(f"{data}/__bucket={b}"))}
        now = {b: p for b, p in before.items() if b not in touched} | made
        version = self.spark.createDataFrame(sorted(now.items()), VERSION).coalesce(1)
        version.write.mode("error").parquet(self._version(number))  # the commit: it counts with its _SUCCESS

    def vacuum(self, keep: int = 1) -> None:
        """Removes all but the last versions, and the data that none of those names."""
        files, at = self._files()
        last = self.versions()[-keep:]
        named = {p.rsplit("/", 1)[0] for v in last for p in (r.path for r in self.spark.read.schema(VERSION).parquet(self._version(v)).collect())}
        for folder in ("versions", "data"):
            for x in files.globStatus(at(f"{self.path}/{folder}/*")) or []:
                name = x.getPath().getName()
                number = int(name.split("-")[0])
                if number <= last[-1] and (number not in last if folder == "versions" else f"{self.path}/data/{name}" not in named):
                    files.delete(x.getPath(), True)

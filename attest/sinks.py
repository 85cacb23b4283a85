"""Where results go: tables partitioned by session, a report for each session, and its sections as a CSV file."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce
from typing import IO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.operators.findings import class_counts, pillars, readiness
from attest.operators.explain import questions, summaries
from attest.operators.serving import comparison_section, figure_rows, finding_rows
from attest.plans.rulepack import RulePack
from attest.sources.session import once


def append(df: DataFrame, path: str) -> None:
    """Adds rows (observations, findings) to a table of sessions."""
    df.write.mode("append").partitionBy("session_id").parquet(path)


def replace(df: DataFrame, path: str) -> None:
    """Puts rows in the place of those of the same sessions; other sessions stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(path)


def reports(n: DataFrame, f: DataFrame, pack: RulePack = RulePack()) -> DataFrame:
    """One row for each session: score, band, ceiling, class counts, pillars, summary and questions.

    f: explained findings.
    """
    p = pillars(n, f).groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pillar", F.struct("pillar_score", "weight", "problems", "applicable"))))).alias("pillars"))
    q = questions(f).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("priority", "question", "ref_code"))).alias("questions"))
    r = readiness(n, f).join(p, "session_id").join(class_counts(f), "session_id", "left").join(q, "session_id", "left").join(summaries(n, f), "session_id", "left")
    return r.withColumns({"rulepack_version": F.lit(pack.version), "status": F.lit("complete")})


def with_changes(table: DataFrame, changes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A table of sessions with some columns from changes(session_id, ...) where it has the session: status, notes, rates."""
    new = changes.select("session_id", F.lit(True).alias("__has"), *[F.col(c).alias(f"__{c}") for c in columns])
    j = table.join(new, "session_id", "left")
    return j.withColumns({c: F.when(F.col("__has"), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}).drop("__has", *[f"__{c}" for c in columns])


#: The order of a report's lines: section, then up to three columns of its rows.
_ORDER = ("section", "place", "first", "second", "third")


def _cell(df: DataFrame, name: str) -> Column:
    """A column as a cell of CSV: quoted where it must be, numbers to six decimals, nulls empty."""
    kind, c = dict(df.dtypes).get(name, "string"), F.col(name)
    if kind in ("double", "float"):
        return _number(c)
    return _quoted(c.cast("string"))


def _number(c: Column) -> Column:
    return F.when(c.isNotNull(), F.regexp_replace(F.format_string("%.6f", c), r"\.?0+$", "")).otherwise("")


def _quoted(c: Column) -> Column:
    return F.coalesce(F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c), F.lit(""))


def report_lines(report: DataFrame, f: DataFrame, obs: DataFrame) -> DataFrame:
    """(session_id, section, place, first, second, third, line): every line of each session's report as CSV.

    Sections: 0 head, 1 score, 2 findings, 3 figures, 4 the comparison of kinds of documents, which has the
    columns of its session's own kinds. Sorted by the columns between, a session's lines are its report.
    Defined cases: a session without a report has no lines; one without findings or figures has these
    sections without rows; equal figures come as often as they are there.
    """
    none, no_text = F.lit(None).cast("double"), F.lit("")

    def lines(df: DataFrame, section: int, place: int, line: Column, first: Column = none, second: Column = no_text, third: Column = no_text) -> DataFrame:
        return df.select("session_id", F.lit(section).alias("section"), F.lit(place).alias("place"), first.cast("double").alias("first"), second.alias("second"), third.alias("third"), line.alias("line"))

    def fixed(section: int, *texts: str) -> DataFrame:
        every = F.posexplode(F.array(*[F.lit(t) for t in texts])).alias("i", "line")
        return lines(report.select("session_id", every), section, -1, F.col("line"), F.col("i"))

    known = report.select("session_id")
    head = report.select("session_id", F.posexplode(F.array(F.lit("\ufeffVerification report"), *[F.concat(F.lit(f"{title},"), _cell(report, c)) for title, c in (("Session", "session_id"), ("Readiness score", "score"), ("Assessment", "band"), ("Rule pack version", "rulepack_version"))])).alias("i", "line"))
    parts = report.select("session_id", F.explode("pillars").alias("pillar", "p")).select("session_id", "pillar", "p.*")
    share = F.format_string("%.0f%%", F.col("weight") * 100)
    assessed = F.when(F.col("applicable"), "yes").otherwise("no documents provided")
    out = [
        lines(head, 0, 0, F.col("line"), F.col("i")),
        fixed(1, "", "SCORE BREAKDOWN", "Pillar,Score,Weight,Findings,Assessed"),
        lines(parts, 1, 0, F.concat_ws(",", "pillar", _cell(parts, "pillar_score"), share, _cell(parts, "problems"), assessed), none, F.col("pillar")),
    ]
    found, figures = finding_rows(f.join(known, "session_id", "left_semi")), figure_rows(obs.join(known, "session_id", "left_semi"))
    for section, title, rows, order in ((2, "FINDINGS", found, (-F.col("severity"), F.col("ref_code"), no_text)), (3, "EXTRACTED FIGURES", figures, (none, F.concat_ws("|", "metric_key", "period_key"), F.coalesce("filename", no_text)))):
        names = [c for c in rows.columns if c != "session_id"]
        out += [fixed(section, "", title, ",".join(names)), lines(rows, section, 0, F.concat_ws(",", *[_cell(rows, c) for c in names]), *order)]
    table = comparison_section(obs.join(known, "session_id", "left_semi"))
    values = F.transform("kinds", lambda k: F.when(F.map_contains_key("values", k), _number(F.element_at("values", k))).otherwise("-"))
    titles = table.select("session_id", "kinds").distinct().select("session_id", F.posexplode(F.array(no_text, F.lit("COMPARISON MATRIX"), F.concat_ws(",", F.lit("metric_key"), F.lit("period_key"), F.transform("kinds", _quoted), F.lit("source_count")))).alias("i", "line"))
    cells = F.concat_ws(",", _cell(table, "metric_key"), _cell(table, "period_key"), values, F.col("source_count").cast("string"))
    out += [lines(titles, 4, -1, F.col("line"), F.col("i")), lines(table, 4, 0, cells, none, F.col("metric_key"), F.col("period_key"))]
    return reduce(DataFrame.unionByName, out)


def csv_report(out: IO[str], session_id: str, report: DataFrame, f: DataFrame, obs: DataFrame) -> None:
    """One session's report as a CSV file in sections, with a byte order mark; lines pass one by one."""
    report, f, obs = (d.where(F.col("session_id") == session_id) for d in (report, f, obs))
    for r in report_lines(once(report), once(f), obs).orderBy(*_ORDER, "line").toLocalIterator():
        out.write(r.line + "\r\n")


def csv_reports(report: DataFrame, f: DataFrame, obs: DataFrame, path: str) -> None:
    """A CSV file for each session of `report`, session_id.csv in the folder `path`, in one job.

    Executors write and sort the files in a draft; a rename then puts each in its place, over an older
    one if there is one, so a file is there as a whole or not at all. The driver sees names of files only.
    Session ids are escaped as Spark escapes names of folders. The report and the findings are written once
    first, as each section reads them.
    """
    spark = report.sparkSession
    draft = f"{path}/_draft-{uuid.uuid4().hex}"
    rows = report_lines(once(report), once(f), obs).withColumn("session_id", F.coalesce("session_id", F.lit("")))  # never null, so the writer adds no sort of its own
    laid = rows.repartition("session_id").sortWithinPartitions("session_id", *_ORDER, "line")
    laid.select("session_id", "line").write.option("lineSep", "\r\n").option("maxRecordsPerFile", 0).partitionBy("session_id").text(draft)
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    folder = hadoop.Path(draft)
    files = folder.getFileSystem(conf)
    names = hadoop.FileContext.getFileContext(files.makeQualified(folder).toUri(), conf)
    over = spark._sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    over[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    for x in files.globStatus(hadoop.Path(f"{draft}/session_id=*/part-*")) or []:
        name = x.getPath().getParent().getName().removeprefix("session_id=")
        names.rename(x.getPath(), files.makeQualified(hadoop.Path(path, f"{name}.csv")), over)
    files.delete(folder, True)

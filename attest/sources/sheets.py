"""Documents as sources: sheets to cells and tables of text, kinds of documents, and chunks of long texts."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from functools import reduce
from operator import or_
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of a chunk, and the share by which one may grow past that for want of a page's end.
CHUNK = 45_000
STRETCH = 1.3
# The words of each kind of document, in the order in which they are tried.
KINDS = (
    ("pitch_deck", ("pitch", "deck", "investor presentation")),
    ("financial_statements", ("balance sheet", "income statement", "cash flow", "profit and loss", "p&l")),
    ("cap_table", ("cap table", "capitalization", "shareholder", "equity holding")),
    ("projections", ("projection", "forecast", "budget", "projected")),
    ("mis", ("mis", "management information", "dashboard", "kpi")),
)
SHEETS, PAGES = (".xlsx", ".csv"), (".pdf", ".pptx")
CELL = "path string, sheet string, row int, col int, kind string, value string, shown string, format string"


def suffix_of(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1))


def reader_of(name: Column) -> Column:
    """Which reader a file's name asks for: sheet or page; null for other types."""
    return F.when(suffix_of(name).isin(*SHEETS), "sheet").when(suffix_of(name).isin(*PAGES), "page")


def document_kind(text: Column, filename: Column | None = None) -> Column:
    """The first kind of which the file's name or the first 1000 characters have a word; "mis" must be a word of its own."""
    start = F.lower(F.concat_ws(" ", filename if filename is not None else F.lit(""), F.substring(F.coalesce(text, F.lit("")), 1, 1000)))
    has = lambda w: start.rlike(r"\bmis\b") if w == "mis" else F.contains(start, F.lit(w))
    return F.coalesce(*[F.when(reduce(or_, [has(w) for w in words]), kind) for kind, words in KINDS], F.lit("unknown"))


def column_letter(index: Column) -> Column:
    """A column's letters from its number: 0 is A, 26 is AA, 18278 is AAAA; a negative number has none, up to 2**53 all do."""
    letters, n = [], index.cast("long")
    for _ in range(12):
        letters.insert(0, F.when(n >= 0, F.char(65 + n % 26)))
        n = F.floor(n / 26) - 1
    return F.when(index.isNotNull(), F.concat_ws("", *letters))


def is_percent_format(fmt: Column, shown: Column) -> Column:
    return F.coalesce(F.contains(fmt, F.lit("%")), F.lit(False)) | F.coalesce(F.endswith(F.trim(shown), F.lit("%")), F.lit(False))


def cell_text(kind: Column, value: Column, shown: Column, fmt: Column) -> Column:
    """What a reader of the sheet sees in a cell: the shown text, else the value; a share in a percent format as such, a day number as its date."""
    number = value.try_cast("double")
    share = F.format_string("%.4f", F.floor(number * 100 * 10000 + 0.5) / 10000)
    percent = F.concat(F.regexp_replace(F.regexp_replace(share, r"(\.\d*?)0+$", "$1"), r"\.$", ""), F.lit("%"))
    day = F.date_format(F.date_add(F.lit("1899-12-30").cast("date"), number.cast("int")), "yyyy-MM-dd")
    plain = F.when((kind == "number") & is_percent_format(fmt, shown) & number.isNotNull(), percent).when((kind == "day") & number.isNotNull(), day).otherwise(value)
    return F.coalesce(F.nullif(F.trim(shown), F.lit("")), plain, F.lit(""))


def csv_cells(spark: SparkSession, path: str) -> DataFrame:
    """The cells of CSV files (a file is one row of bytes: uploads are bounded), as CELL."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                rows = csv.reader(io.StringIO(content.decode("utf-8-sig", "replace"), newline=""))
                cells = [(name, "Sheet1", r, c, "text", v, v, None) for r, row in enumerate(rows, 1) for c, v in enumerate(row)]
                yield pd.DataFrame(cells, columns=[x.split()[0] for x in CELL.split(", ")])

    return files.mapInPandas(run, CELL)


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Number formats of the file format that are not written out: percentages and dates.
_BUILT_IN = {9: "0%", 10: "0.00%", 14: "m/d/yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 22: "m/d/yy h:mm"}


def _workbook(content: bytes) -> Iterator[tuple]:
    """(sheet, row, column, kind, value, format) of an XLSX file's cells."""
    z = zipfile.ZipFile(io.BytesIO(content))
    tree = lambda name: ElementTree.fromstring(z.read(name)) if name in z.namelist() else None
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{_NS}t"))
    shared, styles = tree("xl/sharedStrings.xml"), tree("xl/styles.xml")
    strings = [text(x) for x in shared] if shared is not None else []
    formats: list[str | None] = []
    if styles is not None:
        own = {int(x.get("numFmtId")): x.get("formatCode") for x in styles.iter(f"{_NS}numFmt")}
        xfs = styles.find(f"{_NS}cellXfs")
        formats = [own.get(i := int(x.get("numFmtId", 0)), _BUILT_IN.get(i)) for x in (xfs if xfs is not None else ())]
    links = {x.get("Id"): x.get("Target") for x in tree("xl/_rels/workbook.xml.rels")}
    for sheet in tree("xl/workbook.xml").iter(f"{_NS}sheet"):
        target = links[sheet.get(_REL)].lstrip("/")
        for c in tree(target if target.startswith("xl/") else f"xl/{target}").iter(f"{_NS}c"):
            letters, row = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
            col = reduce(lambda n, x: n * 26 + ord(x) - 64, letters, 0) - 1
            v, kind, style = c.find(f"{_NS}v"), c.get("t", "n"), int(c.get("s", 0))
            fmt = formats[style] if style < len(formats) else None
            value = text(c) if kind == "inlineStr" else None if v is None else strings[int(v.text)] if kind == "s" else v.text
            if value is not None:
                dated = kind == "n" and fmt is not None and "%" not in fmt and re.search(r"[dy]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", fmt.lower()))
                yield sheet.get("name"), int(row), col, "day" if dated else "number" if kind == "n" else "text", value, fmt


def xlsx_cells(spark: SparkSession, path: str) -> DataFrame:
    """The cells of XLSX files, as CELL; shown is null, as the files hold values and formats."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                cells = [(name, s, r, c, k, v, None, f) for s, r, c, k, v, f in _workbook(content)]
                yield pd.DataFrame(cells, columns=[x.split()[0] for x in CELL.split(", ")])

    return files.mapInPandas(run, CELL)


def sheet_rows(cells: DataFrame) -> DataFrame:
    """(path, sheet, row, cells) of rows with content; each row has its sheet's columns, texts without line feeds and with pipes escaped."""
    text = F.regexp_replace(F.replace(cell_text(F.col("kind"), F.col("value"), F.col("shown"), F.col("format")), F.lit("|"), F.lit("\\|")), r"\r?\n", " ")
    c = cells.withColumn("text", text)
    edges = c.groupBy("path", "sheet").agg(F.min("col").alias("left"), F.max("col").alias("right"))
    rows = c.groupBy("path", "sheet", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("at"), F.bool_or(F.col("text") != "").alias("full")).where("full")
    line = F.transform(F.sequence("left", "right"), lambda i: F.coalesce(F.col("at")[i], F.lit("")))
    return rows.join(edges, ["path", "sheet"]).select("path", "sheet", "row", F.col("left"), line.alias("cells"))


def sheet_text(cells: DataFrame) -> DataFrame:
    """(path, text): each file's sheets as tables, of which the first column names a row's first cell; a file without content has no row."""
    rows = sheet_rows(cells)
    first = rows.groupBy("path", "sheet").agg(F.min("row").alias("head"))
    r = rows.join(first, ["path", "sheet"])
    cells_ = F.array_join("cells", " | ")
    rule = F.array_join(F.transform("cells", lambda _: F.lit("---")), " | ")
    line = F.when(F.col("row") == F.col("head"), F.concat(F.lit("| Cell | "), cells_, F.lit(" |\n| --- | "), rule, F.lit(" |\n"))).otherwise(F.concat(F.lit("| "), column_letter(F.col("left")), F.col("row").cast("string"), F.lit(" | "), cells_, F.lit(" |\n")))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["line"]), "")
    sheets = r.select("path", "sheet", "row", line.alias("line")).groupBy("path", "sheet").agg(joined(F.struct("row", "line")).alias("body"))
    table = F.concat(F.lit("## Sheet: "), "sheet", F.lit("\n\n"), "body", F.lit("\n"))
    return sheets.select("path", "sheet", table.alias("line")).groupBy("path").agg(joined(F.struct("sheet", "line")).alias("text"))


def chunks(text: Column, most: int = CHUNK) -> Column:
    """A long text cut at lines: at the start of a page or slide past `most` characters, else before `most` times STRETCH.

    A text that is short enough is one chunk; null and empty texts have none. The fold runs over the
    lines' lengths alone; the chunks are put together once.
    """
    lines = F.split(text, "\n")
    opens = lambda x: x.rlike(r"(?i)^\s*(#+\s*)?(page|slide)\s+\d+") | x.rlike(r"^---\s*$")
    sized = F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.length(x).alias("n"), opens(x).alias("opens")))
    state = F.struct(F.array(F.lit(0)).alias("cuts"), F.lit(0).alias("size"))

    def step(t: Column, x: Column) -> Column:
        grown = t["size"] + x["n"]
        cut = (t["size"] > 0) & (((grown > most) & x["opens"]) | (grown > most * STRETCH))
        return F.struct(F.when(cut, F.concat(t["cuts"], F.array(x["i"]))).otherwise(t["cuts"]).alias("cuts"), (F.when(cut, 0).otherwise(t["size"]) + x["n"] + 1).alias("size"))

    cuts = F.aggregate(sized, state, step, lambda t: t["cuts"])
    ends = F.concat(F.slice(cuts, F.lit(2), F.size(cuts)), F.array(F.size(lines)))
    made = F.zip_with(cuts, ends, lambda a, z: F.concat(F.array_join(F.slice(lines, a + 1, z - a), "\n"), F.lit("\n")))
    kept = F.filter(made, lambda c, i: (i < F.size(cuts) - 1) | (F.trim(F.regexp_replace(c, r"\s+", " ")) != ""))
    none = F.array().cast("array<string>")
    return F.when(text.isNull() | (text == ""), none).when(F.length(text) <= most, F.array(text)).otherwise(kept)

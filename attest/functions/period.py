"""Fiscal periods: text to a canonical period struct, and its sort key. The year starts in April."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_FULL = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def year_label(start: Column) -> Column:
    return F.format_string("FY%d-%02d", start.cast("int"), ((start + 1) % 100).cast("int"))


def fiscal_start(month: Column, year: Column) -> Column:
    return F.when(month >= 4, year).otherwise(year - 1)


def fiscal_quarter(month: Column) -> Column:
    return (F.floor((month + 8) % 12 / 3) + 1).cast("int")


def _year(text: Column) -> Column:
    n = text.try_cast("int")
    return F.when(n >= 100, n).when(n < 70, n + 2000).otherwise(n + 1900)


def _part(s: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(s, pattern, group), F.lit(""))


_FIELDS = ("period_key", "granularity", "fy", "quarter", "month", "conf", "quality")


def parse_period(df: DataFrame, raw: str, out: str = "period") -> DataFrame:
    """df with struct(period_key, granularity, fy, quarter, month, conf, quality) of a period's text.

    Tried in order: relative year, month and year, quarter and year, year; else UNKNOWN. The parts
    are columns of their own on the way, so that each pattern is searched once.
    """
    s = F.col("__s")
    d = df.withColumn("__s", F.regexp_replace(F.trim(F.lower(F.coalesce(raw, F.lit("")))), r"\s+", " "))
    d = d.withColumn("__four", _part(s, r"\b((?:19|20)\d{2})\b", 1))
    four = F.col("__four")
    words = [(rf"\b({a}|{b}|{a}t)\b" if a == "sep" else rf"\b({a}|{b})\b") for a, b in zip(_MONTHS, _FULL, strict=True)]
    d = d.withColumns(
        {
            "__rel": F.when(four.isNull(), _part(s, r"\b(?:projected )?(?:year|yr|y) ?[-.]? ?([1-9])\b", 1)),
            "__named": F.coalesce(*[F.when(s.rlike(w), i + 1) for i, w in enumerate(words)], _part(s, r"^(0?[1-9]|1[0-2])/(?:19|20)\d{2}$", 1).try_cast("int")),
            "__year": F.coalesce(four, _part(s, r"[-' ](\d{2})\b", 1)),
            "__span": _part(s, r"\b(?:fy ?)?(\d{4}|\d{2}) ?[-/–] ?(\d{4}|\d{2})\b", 1),
            "__single": F.coalesce(_part(s, r"\bfy ?'? ?(\d{4}|\d{2})\b", 1), _part(s, r"\b[1-4]q ?'?(\d{4}|\d{2})\b", 1)),
            "__q": F.coalesce(_part(s, r"\bq ?([1-4])\b", 1), _part(s, r"\b([1-4]) ?q", 1)).try_cast("int"),
        }
    )
    d = d.withColumns({"__cal": _year(F.col("__year")), "__fy": F.coalesce(_year(F.col("__span")), _year(F.col("__single")) - 1, four.try_cast("int") - 1), "__exact": F.coalesce("__span", "__single").isNotNull()})
    d = d.withColumns(
        {
            "__kind": F.when(F.col("__rel").isNotNull(), "relative").when(F.col("__named").isNotNull() & F.col("__cal").isNotNull(), "month").when(F.col("__q").isNotNull() & F.col("__fy").isNotNull(), "quarter").when(F.col("__fy").isNotNull(), "fy").otherwise("unknown"),
            "__start": fiscal_start(F.col("__named"), F.col("__cal")),
        }
    )
    kind = F.col("__kind")
    quality = F.when(kind.isin("relative", "unknown"), kind).when((kind == "month") | F.col("__exact"), "exact").otherwise("inferred")
    key = (
        F.when(kind == "relative", F.concat(F.lit("REL-Y"), "__rel"))
        .when(kind == "month", F.concat(F.format_string("M%02d-", "__named"), year_label(F.col("__start"))))
        .when(kind == "quarter", F.concat(F.format_string("Q%d-", "__q"), year_label(F.col("__fy"))))
        .when(kind == "fy", year_label(F.col("__fy")))
        .otherwise("UNKNOWN")
    )
    parts = F.struct(
        key.alias("period_key"),
        F.when(kind == "relative", "fy").otherwise(kind).alias("granularity"),
        F.when(kind == "month", F.col("__start")).when(kind.isin("quarter", "fy"), F.col("__fy")).cast("int").alias("fy"),
        F.when(kind == "month", fiscal_quarter(F.col("__named"))).when(kind == "quarter", F.col("__q")).cast("int").alias("quarter"),
        F.when(kind == "month", F.col("__named")).cast("int").alias("month"),
        F.when(quality == "exact", 1.0).when(quality == "inferred", 0.8).when(quality == "relative", 0.6).otherwise(0.5).alias("conf"),
        quality.alias("quality"),
    )
    return d.withColumn(out, parts).drop("__s", "__four", "__rel", "__named", "__year", "__span", "__single", "__q", "__cal", "__fy", "__exact", "__kind", "__start")


def parse_with_hint(df: DataFrame, raw: str, hint: str, out: str = "period") -> DataFrame:
    """parse_period() of raw, or else of the document's hint, with less confidence."""
    d = parse_period(parse_period(df, raw, out), hint, "__hint")
    told = F.col("__hint")
    weaker = F.struct(*[told[c].alias(c) for c in _FIELDS[:5]], F.lit(0.6).alias("conf"), F.lit("inferred_from_document").alias("quality"))
    use = (F.col(out)["quality"] == "unknown") & (told["quality"] != "unknown")
    return d.withColumn(out, F.when(use, weaker).otherwise(F.col(out))).drop("__hint")


def sort_key(period: Column) -> Column:
    """A whole number in time order; null for relative and unknown periods."""
    month = (period["month"] + 8) % 12 + 1
    return period["fy"] * 100 + F.coalesce(month, (period["quarter"] - 1) * 3 + 1, F.lit(0))


def comparable(key: Column) -> Column:
    return key.isNotNull() & (key != "UNKNOWN")


def human_period(key: Column) -> Column:
    """A period's key as a person would say it: March 2025, Q3 FY2024-25, projected year 1."""
    month, start = _part(key, r"^M(\d\d)-FY(\d{4})-\d\d$", 1).try_cast("int"), _part(key, r"^M(\d\d)-FY(\d{4})-\d\d$", 2).try_cast("int")
    names = F.array(*[F.lit(x.capitalize()) for x in _FULL])
    named = F.concat(F.get(names, month - 1), F.lit(" "), F.when(month >= 4, start).otherwise(start + 1).cast("string"))
    return (
        F.when(~comparable(key) | key.isNull(), "an unstated period")
        .when(month.between(1, 12), named)
        .when(key.rlike(r"^Q\d-FY\d{4}-\d\d$"), F.replace(key, F.lit("-FY"), F.lit(" FY")))
        .when(key.rlike(r"^REL-Y\d$"), F.concat(F.lit("projected year "), F.substring(key, 6, 1)))
        .otherwise(key)
    )


def months_of_year(fy: Column) -> Column:
    """The twelve month keys of a fiscal year, from April."""
    return F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.concat(F.format_string("M%02d-", (i + 3) % 12 + 1), year_label(fy)))


def quarters_of_year(fy: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(4)), lambda q: F.concat(F.format_string("Q%d-", q), year_label(fy)))


def months_of_quarter(fy: Column, quarter: Column) -> Column:
    """The three month keys of a fiscal quarter."""
    return F.slice(months_of_year(fy), (quarter - 1) * 3 + 1, F.lit(3))

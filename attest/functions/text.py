"""Figures in text: currency, scale, number and percentage, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens in the order in which they are tried.
CURRENCIES = (("₹", "INR"), ("rs.", "INR"), ("rs", "INR"), ("inr", "INR"), ("usd", "USD"), ("us$", "USD"), ("$", "USD"), ("eur", "EUR"), ("€", "EUR"), ("gbp", "GBP"), ("£", "GBP"), ("aed", "AED"), ("sgd", "SGD"))
SCALES = (
    ("trillion", 1e12), ("billion", 1e9), ("million", 1e6), ("thousand", 1e3), ("hundred", 1e2), ("crores", 1e7), ("crore", 1e7),
    ("lakhs", 1e5), ("lakh", 1e5), ("lacs", 1e5), ("lac", 1e5), ("cr.", 1e7), ("cr", 1e7), ("bn", 1e9), ("mn", 1e6), ("tn", 1e12),
    ("k", 1e3), ("m", 1e6), ("b", 1e9),
)


def currency_of(raw: Column) -> Column:
    """The first listed currency whose token the text contains, else null."""
    low = F.lower(raw)
    return F.coalesce(*[F.when(F.contains(low, F.lit(t)), c) for t, c in CURRENCIES])


def scale_of(raw: Column) -> Column:
    """The first listed scale word, else 1.

    Tokens of one or two letters must follow a digit and end a word; longer ones only may not stand
    inside a longer word, so "50lakh" has one and "place" has none.
    """
    low = F.lower(raw)

    def pattern(token: str) -> str:
        if len(token) <= 2:
            return rf"\d\s*{token}\b"
        return rf"(?<![a-z]){token.replace('.', '[.]')}" + ("(?![a-z])" if token[-1] != "." else "")

    return F.coalesce(*[F.when(low.rlike(pattern(t)), f) for t, f in SCALES], F.lit(1.0))


def number_of(raw: Column) -> Column:
    """The number in a text, negative in parentheses or with a minus at either end; a currency's dot is no point."""
    plain = F.trim(raw)
    inner = F.when(plain.rlike(r"^\(.*\)$"), F.substring(plain, F.lit(2), F.length(plain) - 2)).otherwise(plain)
    negative = plain.rlike(r"^\(.*\)$") | inner.rlike(r"^\s*-|-\s*$")
    digits = F.regexp_replace(F.regexp_replace(F.lower(inner), r"rs\.", ""), r"[^0-9.]", "")
    first = F.regexp_extract(digits, r"^([0-9]*[.]?)", 1)
    one_point = F.concat(first, F.regexp_replace(F.substring(digits, F.length(first) + 1, F.length(digits)), "[.]", ""))
    value = F.when(digits.rlike("[0-9]"), one_point.try_cast("double"))
    return F.when(negative, -value).otherwise(value)


def is_percent(raw: Column) -> Column:
    return F.contains(raw, F.lit("%")) | F.lower(raw).rlike(r"\b(percent|pct)\b")


def is_reference(raw: Column) -> Column:
    """Prose that only cites a figure's place, such as a note number."""
    words = F.size(F.regexp_extract_all(F.lower(raw), F.lit("[a-z]{3,}"), F.lit(0)))
    return currency_of(raw).isNull() & (scale_of(raw) == 1.0) & ~is_percent(raw) & (words >= 2)


def value_of(raw: Column, model: Column, unit: Column) -> Column:
    """struct(value, currency, multiplier, conf, reason) of a figure, with the reader's own number beside it."""
    number, scale, percent = number_of(raw), scale_of(raw), is_percent(raw)
    usable = number.isNotNull() & ~is_reference(raw)
    value = F.when(usable, F.when(percent, number).otherwise(number * scale)).otherwise(model)
    gap = relative_gap(value, model)
    missed = relative_gap(number, model) <= 0.005
    disagree = usable & model.isNotNull() & (gap > 0.005)
    conf = F.when(~usable & model.isNotNull(), 0.7).when(disagree & missed, 0.85).when(disagree, 0.6).otherwise(1.0)
    reason = F.when(value.isNull(), "unparseable_value").when(~usable, "value_raw_unparseable_used_model_value").when(disagree & missed, "model_missed_scale_multiplier").when(disagree, "model_value_disagrees_with_raw")
    clash = F.when((unit == "currency") & percent, "declared_currency_but_value_is_percentage").when((unit == "pct") & ~percent & currency_of(raw).isNotNull(), "declared_percentage_but_value_is_currency")
    return F.struct(
        value.alias("value"),
        F.when(unit == "currency", currency_of(raw)).alias("currency"),
        scale.alias("multiplier"),
        F.when(clash.isNotNull(), F.least(conf, F.lit(0.5))).otherwise(conf).alias("conf"),
        F.coalesce(clash, reason).alias("reason"),
    )


def relative_gap(a: Column, b: Column) -> Column:
    """|a - b| over the larger magnitude; two zeros have no gap."""
    most = F.greatest(F.abs(a), F.abs(b))
    return F.when(most == 0, 0.0).otherwise(F.try_divide(F.abs(a - b), most))


def rounded(x: Column, places: int) -> Column:
    """Half-up rounding, also for negative numbers."""
    return F.floor(x * 10**places + 0.5) / float(10**places)


def grouped(value: Column) -> Column:
    """A whole amount with Indian digit groups: 5,20,00,000."""
    whole = F.floor(F.abs(value) + 0.5).cast("long").cast("string")
    return F.concat(F.when(value < -0.5, "-").otherwise(""), F.regexp_replace(whole, r"(?<=\d)(?=(\d\d)*\d{3}$)", ","))


def numbered(n: Column, width: int) -> Column:
    """A whole number with zeros before it up to some width; a longer one stays whole, as lpad would cut it."""
    digits = n.cast("string")
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0"))


def plain_number(value: Column, places: int) -> Column:
    """A number with up to some decimals and no trailing zeros: 37.5, 38; null for null, which formats would spell out."""
    fixed = F.when(value.isNotNull(), F.format_string(f"%.{places}f", rounded(value, places)))
    return F.regexp_replace(F.regexp_replace(fixed, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def percent_text(value: Column, places: int = 2) -> Column:
    return F.coalesce(F.concat(plain_number(value, places), F.lit("%")), F.lit("an unknown amount"))


def points_text(value: Column, places: int = 2) -> Column:
    """A difference of percentages, in percentage points."""
    n = plain_number(value, places)
    return F.coalesce(F.concat(n, F.when(n == "1", " percentage point").otherwise(" percentage points")), F.lit("an unknown amount"))


# How amounts of a currency begin; others by code and blank.
SIGNS = {"INR": "Rs ", "USD": "$", "EUR": "€", "GBP": "£"}


def amount_text(value: Column, currency: Column) -> Column:
    """A whole amount with its currency's sign and Indian digit groups; null is a dash."""
    sign = F.coalesce(*[F.when(currency == c, s) for c, s in SIGNS.items()], F.concat(currency, F.lit(" ")), F.lit(""))
    return F.coalesce(F.concat(sign, grouped(value)), F.lit("-"))


def figure_text(value: Column, unit: Column, currency: Column) -> Column:
    """A figure in the unit of its metric."""
    return F.when(value.isNull(), "-").otherwise(
        F.when(unit == "pct", percent_text(value))
        .when(unit == "count", grouped(value))
        .when(unit == "months", F.concat(plain_number(value, 1), F.lit(" months")))
        .when(unit == "ratio", F.concat(plain_number(value, 2), F.lit("x")))
        .otherwise(amount_text(value, F.coalesce(currency, F.lit("INR"))))
    )


def conversion_text(value: Column, currency: Column, rate: Column, converted: Column, base: str = "INR") -> Column:
    """The conversion of an amount as an equation."""
    return F.concat(amount_text(value, currency), F.lit(" x "), plain_number(rate, 6), F.lit(" = "), amount_text(converted, F.lit(base)))

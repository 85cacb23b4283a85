"""Line-first cleaning of documents, all by DataFrame functions.

Every line is judged on its own: it fails if it has few words and no sentence end (navigation), holds a
boilerplate phrase, or is mostly marks. Failing lines are removed, and a
document that loses more than a share of its words is rejected.

Words are runs of anything but the six ASCII white-space characters. Defined cases: null and empty
texts have no words and fail the base rule; very long texts are read whole; equal rows have equal
results; an empty table gives an empty one; clean() replaces columns of the same names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.llm.shared import WHITE, WHITE_CLASS

# The six white-space characters of the contract and its symbols.
_WHITE_RUN = WHITE_CLASS + "+"
_SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rules:
    window: int = 8
    least_words: int = 20
    most_repeated: int = 30
    #: A line of fewer words without a sentence end is navigation.
    navigation_words: int = 4
    boilerplate: tuple[str, ...] = ("cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "click here", "subscribe to our", "javascript is disabled", "share this", "licensed under")
    sentence_end: str = r"[.!?…:;]['\")\]»”]*[\x20\x09-\x0D]*$"
    #: A line in which at least this share of the words carry a run of marks is noise.
    marks: str = r"([#*$%&|<>]{2,}|!!)"
    noisy: float = 0.5
    #: The share of its words that a document may lose.
    most_lost: float = 0.5


def _trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def words_of(text: Column) -> Column:
    """The words of a text; null and blank texts have none."""
    trimmed = _trimmed(F.coalesce(text, F.lit("")))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _WHITE_RUN))


def _holds(text: Column, phrases: tuple[str, ...]) -> Column:
    low = F.lower(text)
    return reduce(or_, [F.contains(low, F.lit(x)) for x in phrases], F.lit(False))


def line_fails(line: Column, n: Column, marked: Column, boiler: Column, rules: Rules) -> Column:
    """Whether a line of n words fails; marked and boiler tell if its text holds such things at all."""
    navigation = (n < rules.navigation_words) & ~line.rlike(rules.sentence_end)
    noise = marked & (F.size(F.regexp_extract_all(line, F.lit(rules.marks), F.lit(0))) >= F.greatest(F.lit(1), F.ceil(n * rules.noisy)))
    return navigation | noise | (boiler & _holds(line, rules.boilerplate))


def clean(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """docs with the base counts, clean_text (the lines that passed) and kept."""
    size = rules.window
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn("__words", words_of(F.col(text))).withColumn("n_words", F.size("__words").cast("long"))
    d = d.withColumn("__windows", F.when(F.col("n_words") >= size, F.transform(F.sequence(F.lit(1), (F.col("n_words") - (size - 1)).cast("int")), lambda i: F.xxhash64(F.slice("__words", i, size)))))
    d = d.withColumn("__again", F.coalesce(F.size(F.array_distinct("__windows")) < F.size("__windows"), F.lit(False)))
    d = d.withColumn("__lines", F.filter(F.split(t, "\n"), lambda x: _trimmed(x) != ""))
    d = d.withColumns(
        {
            "word_chars": F.char_length(F.array_join("__words", "")).cast("long"),
            "n_symbols": F.regexp_count(t, F.lit(_SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            # only texts that do repeat a window pay for marking the words
            "n_repeat_words": F.when(F.col("__again"), _covered(F.col("__windows"), size)).otherwise(F.lit(0)).cast("long"),
            "__boiler": _holds(t, rules.boilerplate),
        }
    )
    d = d.withColumn("__marked", (F.col("n_symbols") > 1) | F.contains(t, F.lit("!!")))
    d = d.withColumn("__counted", F.transform("__lines", lambda x: F.struct(x.alias("line"), F.size(F.split(_trimmed(x), _WHITE_RUN)).alias("n"))))
    d = d.withColumn("__passed", F.filter("__counted", lambda x: ~line_fails(x["line"], x["n"], F.col("__marked"), F.col("__boiler"), rules)))
    left = F.aggregate("__passed", F.lit(0), lambda a, x: a + x["n"])
    d = d.withColumn("base_failed", (F.col("n_words") < rules.least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.most_repeated))
    d = d.withColumn("kept", ~F.col("base_failed") & (left >= F.col("n_words") * (1 - rules.most_lost)))
    d = d.withColumn("clean_text", F.array_join(F.col("__passed.line"), "\n"))
    return d.drop("__words", "__windows", "__again", "__lines", "__passed", "__counted", "__boiler", "__marked")


def _covered(windows: Column, size: int) -> Column:
    """How many words stand in a window that is found twice or more, from the windows in order.

    The windows are sorted with their places; neighbours that are equal mark each other's place.
    The union of the marked windows is then summed in order of place.
    """
    state = F.struct(F.lit(-1).alias("end"), F.lit(0).alias("sum"))

    def marked(placed: Column) -> Column:
        return F.filter(placed, lambda p, k: (F.get(placed, k - 1)["w"] == p["w"]) | (F.get(placed, k + 1)["w"] == p["w"]))

    def total(starts: Column) -> Column:
        return F.aggregate(starts, state, lambda a, i: F.struct((i + size).alias("end"), (a["sum"] + (i + size) - F.greatest(a["end"], i)).alias("sum")), lambda a: a["sum"])

    placed = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    return total(F.array_sort(F.transform(bound(placed, marked), lambda p: p["i"])))


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once, though use() names it often and inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def op10_line_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return clean(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")

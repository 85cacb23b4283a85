"""Columns' letters beyond three, and questions in other letters than a to z."""

from pyspark.sql import functions as F

from attest.operators.explain import normalised_question
from attest.sources.sheets import column_letter


def letters(n: int) -> str:
    out = ""
    while n >= 0:
        out, n = chr(65 + n % 26) + out, n // 26 - 1
    return out


def test_letters_of_any_column(spark):
    numbers = [0, 25, 26, 701, 702, 16383, 18277, 18278, 19999, 475253, 475254, 26**7, 2**53 - 1]
    got = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", column_letter(F.col("n")).alias("s")).collect()
    assert {r.n: r.s for r in got} == {n: letters(n) for n in numbers}
    odd = spark.createDataFrame([(None,), (-1,)], "n long").select(column_letter(F.col("n")).alias("s")).collect()
    assert [r.s for r in odd] == [None, ""]


def test_question_keys_hold_plain_letters_alone(spark):
    texts = ["Für die Prüfung: what is  THE\trate?", "café and\x0btea", "an-other of\nyours", "日本", "", None]
    got = [r.s for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(normalised_question(F.col("t")).alias("s")).collect()]
    assert got == ["fr die prfung rate", "cafandtea", "another yours", "", "", None]

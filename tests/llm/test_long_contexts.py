"""Contexts of more than two words."""

import random

import pytest
from pyspark.sql import functions as F

from attest.llm import suffix_tree


def test_third_word_back_decides(spark):
    """Before left and right, the last two words tell nothing, so they are plain; the third one back tells."""
    r, rows = random.Random(5), []
    for i in range(400):
        a = r.choice("pq")
        rows.append((i, f"{a} {r.choice('xy')} {r.choice('uv')} {'left' if a == 'p' else 'right'}"))
        b = r.choice("cd")
        rows.append((1000 + i, f"{b} {r.choice('ef')} {'up' if b == 'c' else 'down'}"))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    s = suffix_tree.Settings(steeper=1)
    got = suffix_tree.score(d, F.col("doc_id") % 1000 < 300, s).where("not train").groupBy().sum("score", "n_tokens").first()
    two = suffix_tree.score(d, F.col("doc_id") % 1000 < 300, suffix_tree.Settings(2, steeper=1)).where("not train").groupBy().sum("score", "n_tokens").first()
    # one bit of log10(2) a text is what the third word back tells
    assert got[0] - two[0] == pytest.approx(100 * 0.301, rel=0.25)


def test_longer_contexts_need_no_more_occurrences(spark):
    """Of three words before left and right, met a dozen times each, the first one tells."""
    r, rows = random.Random(6), []
    for i in range(240):
        a = r.choice("pq")
        rows.append((i, f"{a} {r.choice('xy')} {r.choice('uvwz')} {'left' if a == 'p' else 'right'}"))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got, two = (suffix_tree.score(d, F.col("doc_id") < 200, suffix_tree.Settings(depth)).where("not train").groupBy().sum("score").first()[0] for depth in (4, 2))
    assert got - two == pytest.approx(40 * 0.301, rel=0.35)
    assert {suffix_tree.Settings().needed(k, tokens) for k in range(1, 5) for tokens in (100, 10**12)} == {8}

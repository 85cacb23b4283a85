"""Contexts whose followers go to several buckets are tested like others."""

import random

from pyspark.sql import functions as F

from attest.llm import suffix_tree


def test_results_do_not_depend_on_dealing(spark):
    # after "of" words are as elsewhere, so it goes; after "to" they are others, so it stays; both are common
    r, rows = random.Random(3), []
    plain = [f"w{i}" for i in range(40)]
    for i in range(300):
        words = []
        for _ in range(10):
            words += [r.choice(plain), "of", r.choice(plain), "to", r.choice(["go", "see", "do"])]
        rows.append((i, " ".join(words)))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")

    def scores(s):
        return sorted(tuple(x) for x in suffix_tree.score(d, F.col("doc_id") % 4 > 0, s).collect())

    assert scores(suffix_tree.Settings(3, steeper=2, common=500)) == scores(suffix_tree.Settings(3, steeper=2)) != scores(suffix_tree.Settings(3, steeper=2, evidence=1e9))

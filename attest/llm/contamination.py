"""Benchmark decontamination by spaced-seed hashing, all by DataFrame functions.

A fixed mask names the places of a short window of words whose hashes are joined between test items
and documents; the other places are free, so that a substituted word there does not hide a match.
The two masks here are such that any 13 aligned words of which at least 11 are equal hold a hit of
one of them. Around each hit, on its diagonal (item position less document position), the words are
compared, and a pair is reported if some window of 13 item words has at least 80 % equal words
there.

Items shorter than 13 words are compared as a whole. Their seeds are the item cut into one block more
than the words that may differ, of which one is equal then; documents have seeds of the blocks'
lengths, if there are such items.

Words are lower-cased runs of anything but ASCII white space. Defined cases: null and empty texts
have no seeds and are clean; repeated items and documents give one row for each pair of ids; very long texts are read
whole; empty tables give an empty one; extra columns are ignored by overlaps() and carried by
without_overlaps().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.llm.quality import bound, words_of

#: Places that count, for each mask. Found by search as the smallest set with the stated property.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
_PLACES = sorted({p for m in MASKS for p in m})
WINDOW = 13
PERCENT = 80
#: The test items' seeds are broadcast up to so many rows of 40 bytes; beyond, they are shuffled.
BROADCAST_SEEDS = 1_000_000


def _hashes(text: str) -> Column:
    return F.transform(words_of(F.lower(F.col(text))), lambda w: F.xxhash64(w))


def seeds(texts: DataFrame) -> DataFrame:
    """(id, pos, seed) of texts(id, h): each mask at each place of the word hashes h."""
    shifted = F.arrays_zip(*[F.slice("h", p + 1, F.size("h")).alias(f"w{p}") for p in _PLACES])
    placed = texts.where(F.size("h") > _PLACES[-1]).select("id", F.posexplode(shifted).alias("pos", "w")).where(F.col(f"w.w{_PLACES[-1]}").isNotNull())
    both = F.array(*[F.xxhash64(F.lit(i), *[F.col(f"w.w{p}") for p in m]) for i, m in enumerate(MASKS)])
    return placed.select("id", "pos", F.explode(both).alias("seed"))


def blocks(items: DataFrame) -> DataFrame:
    """(id, pos, size, seed) of the blocks of items(id, h) under WINDOW words."""
    size = F.size("h")
    count = F.floor(size * (100 - PERCENT) / 100).cast("int") + 1
    edge = lambda i: F.floor(i * size / count).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(edge(i).alias("pos"), (edge(i + 1) - edge(i)).alias("size")))
    b = items.where((size > 0) & (size < WINDOW)).select("id", "h", F.explode(cut).alias("b")).select("id", "h", "b.pos", "b.size")
    return b.select("id", "pos", "size", F.xxhash64(F.lit(-1), "size", F.slice("h", F.col("pos") + 1, F.col("size"))).alias("seed"))


def runs(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """(id, pos, seed) of all runs of texts(id, h) that have one of the sizes."""

    def of(n: int) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size("h") - n, F.lit(0)))
        found = F.transform(at, lambda i: F.struct(i.alias("pos"), F.xxhash64(F.lit(-1), F.lit(n), F.slice("h", i + 1, F.lit(n))).alias("seed")))
        return F.when(F.size("h") >= n, found).otherwise(F.slice(found, 1, 0))

    return texts.where(F.size("h") > 0).select("id", F.explode(F.flatten(F.array(*[of(n) for n in sizes]))).alias("r")).select("id", "r.pos", "r.seed")


def _matches(item: Column, doc: Column, diagonal: Column) -> Column:
    """The most equal words in a window of the item that lies along the document at a diagonal."""
    size = F.least(F.lit(WINDOW), F.size(item))

    def best(equal: Column) -> Column:
        first = F.aggregate(F.slice(equal, 1, size), F.lit(0), lambda t, x: t + x)
        start = F.struct(first.alias("now"), first.alias("most"))

        def step(t: Column, i: Column) -> Column:
            now = t["now"] + F.get(equal, i) - F.get(equal, i - size)
            return F.struct(now.alias("now"), F.greatest(t["most"], now).alias("most"))

        moved = F.when(F.size(equal) > size, F.sequence(size, F.size(equal) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(moved, start, step, lambda t: t["most"])

    return bound(F.transform(item, lambda h, i: F.when(h == F.get(doc, i - diagonal), 1).otherwise(0)), best)


def overlaps(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, equal_words, window_words, item_minus_doc) of the pairs that overlap.

    item_minus_doc is the diagonal of the best window. Rows of one doc_id count as one document.
    """
    test = items.select(F.col(item_key).alias("id"), _hashes(item_text).alias("h"))
    train = docs.select(F.col(key).alias("id"), _hashes(text).alias("h"))
    short = blocks(test)
    sizes = sorted(r["size"] for r in short.select("size").distinct().collect())
    wanted = seeds(test.where(F.size("h") >= WINDOW)).unionByName(short.drop("size")).select(F.col("id").alias("item"), F.col("pos").alias("at"), "seed").distinct()
    few = wanted.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS
    small = F.broadcast if few else (lambda x: x)  # an item has at most as many words as seeds, and some
    placed = seeds(train).unionByName(runs(train, sizes)) if sizes else seeds(train)
    hits = placed.join(small(wanted), "seed").select("id", "item", (F.col("at") - F.col("pos")).alias("diagonal")).distinct()
    # of each document only the words along a hit's diagonal go on, so a row is as short as its item
    lengths = test.select(F.col("id").alias("item"), F.size("h").alias("length"))
    lists = hits.join(small(lengths), "item").groupBy("id").agg(F.collect_list(F.struct("item", "diagonal", "length")).alias("near"))
    begin = F.greatest(F.lit(0), -F.col("n.diagonal"))
    stop = F.least(F.size("h"), F.col("n.length") - F.col("n.diagonal"))
    looked = train.join(lists, "id").select("id", "h", F.explode("near").alias("n")).select("id", F.col("n.item").alias("item"), F.col("n.diagonal").alias("diagonal"), begin.alias("begin"), F.slice("h", begin + 1, F.greatest(stop - begin, F.lit(0))).alias("along"))
    pairs = looked.join(small(test.select(F.col("id").alias("item"), F.col("h").alias("words"))), "item")
    size = F.least(F.lit(WINDOW), F.size("words"))
    scored = pairs.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), _matches(F.col("words"), F.col("along"), F.col("diagonal") + F.col("begin")).alias("equal_words"), size.alias("window_words"), F.col("diagonal").alias("item_minus_doc"))
    close = scored.where(F.col("equal_words") * 100 >= F.col("window_words") * PERCENT)
    best = close.groupBy("doc_id", "item_id").agg(F.max(F.struct("equal_words", "window_words", "item_minus_doc")).alias("b"))
    return best.select("doc_id", "item_id", "b.equal_words", "b.window_words", "b.item_minus_doc")


def without_overlaps(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs that overlap with no item; columns as they were."""
    bad = overlaps(docs, items, key, text).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(bad, key, "left_anti").select(*docs.columns)


def op3_contamination(spark, sf_dir: str) -> DataFrame:
    return overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

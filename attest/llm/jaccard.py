"""Similarity join of documents by the Jaccard coefficient of their word n-gram sets.

Rare-first prefix filtering: n-grams are put in one order, by the number of distinct sets that hold them
and then by hash; two sets of similarity t share an n-gram among the first |s| - ceil(t |s|) + 1 of
each. Pairs of one such n-gram pass the length filter, the positional filter (how many n-grams can
still be common from it on, as if it were the first) and a suffix filter (a bit map of each set bounds
the overlap), are made unique, and are verified once on the whole sets.

The counts are of all sets: each part of the input sends its n-grams' hashes in buckets, which are summed,
and gets back those that two sets or more have. Nothing of them is broadcast. Hashes are shortened to
some bits more than a bucket's n-grams need; if two meet, the order changes and no result.

Equal sets are one class. Groups of near copies are joined without all their pairs: first each set
meets the one set of each shared n-gram that holds it earliest; what those links leave in different
components is then compared in full, except inside the components.

Defined cases: null, empty and blank texts have an empty set, link with nothing and are components
of their own; texts of fewer words than n are one n-gram; very long texts are read whole; rows of
one doc_id belong together; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.llm.components import components
from attest.llm.shared import block_hashes, bucket_bits, chunked, delivered, firsts, hashed_blocks, mapped, mixed, packed, part_rows, parts_of, places, returned, shared_folder, spans, text_bytes, unpacked, words_of_texts, written

#: Bytes of text for each bucket of n-grams.
BUCKET = 4 << 20
#: n-grams that a task counts at a time.
_MOST = 3_000_000
#: Runs of buckets that those are sent in.
_SLICES = 32
#: Ids of sets to fetch are broadcast up to so many (16 MB of longs); beyond, the join is shuffled.
BROADCAST_IDS = 2_000_000
#: Words of 64 bits in the smallest map of a set's n-grams' hashes.
MAP_WORDS = 16


@dataclass(frozen=True)
class Settings:
    """words of an n-gram, and the least similarity in hundredths."""

    words: int = 3
    percent: int = 90


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """The sorted distinct n-grams of a sequence of word hashes; a shorter one is one n-gram."""
    if not len(hashes):
        return hashes
    size = min(n, len(hashes))
    m = len(hashes) - size + 1
    out = np.full(m, size, np.uint64)
    for k in range(size):
        out = mixed(out * np.uint64(0x2545F4914F6CDD1D) + hashes[k : k + m])
    return np.unique(out)


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def map_words(size: int) -> int:
    """A power of two of words: two bits at least for each n-gram of a large set."""
    return max(MAP_WORDS, 1 << max(0, (size - 1) // 32).bit_length())


def class_of(g: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over an n-gram set; equal sets have equal ones."""
    if not len(g):
        return 0, 0
    return tuple(int(mixed(x).sum(dtype=np.uint64).view(np.int64)) for x in (g, g ^ np.uint64(0xA5A5A5A5A5A5A5A5)))


def sizes(d: DataFrame, s: Settings) -> DataFrame:
    """(part, doc_id, n_shingles, c1, c2) of d(part, k, t): the size and class of each set."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sets = [(len(g), *class_of(g)) for g in (grams(h, s.words) for _, h in words_of_texts(frame["t"].tolist()))]
            n, c1, c2 = zip(*sets, strict=True) if sets else ((), (), ())
            yield pd.DataFrame({"part": frame["part"], "doc_id": frame["k"], "n_shingles": list(n), "c1": np.array(c1, np.int64), "c2": np.array(c2, np.int64)})

    return mapped(d, run, "part long, doc_id long, n_shingles long, c1 long, c2 long")


class _Chosen:
    """The sets of one part that stand for their classes, each once."""

    def __init__(self, folder: str, part: int) -> None:
        rep, c1, c2 = part_rows(folder, part, ["rep", "c1", "c2"])
        self.left = set(zip(rep.tolist(), c1.tolist(), c2.tolist(), strict=True))
        self.any = bool(self.left)

    def take(self, doc: int, g: np.ndarray) -> bool:
        key = (doc, *class_of(g))
        if key in self.left:
            self.left.discard(key)
            return True
        return False


def _chosen_sets(frames: Iterator[pd.DataFrame], folder: str, words: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(part, doc, n-gram set) of the chosen sets, part after part."""
    part, chosen = None, None
    for frame in frames:
        texts, docs = frame["t"].tolist(), frame["k"].to_numpy()
        for a, z in spans(frame["part"].to_numpy()):
            p = int(frame["part"].iat[a])
            if p != part:
                part, chosen = p, _Chosen(folder, p)
            wanted = {r for r, _, _ in chosen.left}
            at = [i for i in range(a, z) if docs[i] in wanted]
            for i, h in words_of_texts([texts[i] for i in at]):
                g = grams(h, words)
                if chosen.take(int(docs[at[i]]), g):
                    yield p, int(docs[at[i]]), g


def asked_counts(d: DataFrame, reps: str, s: Settings, bits: int) -> DataFrame:
    """(part, bucket, keys, n): in how many chosen sets of each part its n-grams are."""

    def blocks(part: int, held: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        g = np.concatenate(held)
        held.clear()
        g.sort()
        # some buckets at a time, so that little is held beside the n-grams
        for a, z in spans((g >> np.uint64(64 - bits)) // np.uint64(max(1, (1 << bits) // _SLICES))):
            some = g[a:z]
            at = firsts(some)
            yield hashed_blocks(part, some[at], bits, n=np.minimum(np.diff(np.append(at, len(some))), 65535).astype(np.uint16))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held, size = None, [], 0
        for p, _, g in _chosen_sets(frames, reps, s.words):
            if held and (p != part or size > _MOST):
                yield from blocks(part, held)
                size = 0
                returned()
            part = p
            held.append(g)
            size += len(g)
        if held:
            yield from blocks(part, held)
        returned()

    return d.mapInPandas(run, "part long, bucket long, keys binary, n binary")


def level_of(n: np.ndarray) -> np.ndarray:
    """Counts in 256 steps that keep their order: each number below 64, then 12 steps for each doubling."""
    return np.where(n < 64, n, np.minimum(255, 64 + 12 * np.log2(np.maximum(n, 64) / 64))).astype(np.uint8)


def _counted(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One bucket: the n-grams of each part that are in two sets or more of all parts, with their level."""
    arrays = [unpacked(k) for k in rows["keys"]]
    k = np.concatenate(arrays)
    u, inverse = np.unique(k, return_inverse=True)
    n = np.bincount(inverse, weights=np.frombuffer(b"".join(rows["n"]), np.uint16), minlength=len(u)).astype(np.int64)
    several, level = (n > 1)[inverse], level_of(n)[inverse]
    ends = np.cumsum([len(a) for a in arrays])
    out = []
    for part, a, z in zip(rows["part"], ends - [len(x) for x in arrays], ends, strict=True):
        hit = several[a:z]
        out.append({"part": part, "bucket": key[0], "keys": packed(k[a:z][hit]), "level": level[a:z][hit].tobytes()})
    return pd.DataFrame(out)


class _Levels:
    """The levels of one part's n-grams that are in two sets or more."""

    def __init__(self, folder: str, part: int, bits: int) -> None:
        bucket, keys, level = part_rows(folder, part, ["bucket", "keys", "level"])
        if not len(bucket):
            raise ValueError(f"no counts came back for part {part}")
        h = block_hashes(bucket, keys)
        # a part that two tasks asked for has some n-grams twice, with the same level
        order = np.argsort(h, kind="stable")
        self.h, self.level, self.shift = h[order], np.frombuffer(b"".join(level), np.uint8)[order], np.uint64(32 - bits)

    def of(self, g: np.ndarray) -> np.ndarray:
        at = places(self.h, g >> self.shift)
        return np.where(at >= 0, self.level[at], 1) if len(self.h) else np.ones(len(g), np.uint8)


def prefixes(d: DataFrame, reps: str, counts: str, s: Settings, bits: int) -> DataFrame:
    """(rep, n, prefix, pos, bits) of the chosen sets that can have a partner.

    The order is rare first, by exact counts of sets. N-grams that no other set has come first, can't be
    common, and are left out of prefix, whose places are in pos.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, out = None, []
        for p, doc, g in _chosen_sets(frames, reps, s.words):
            if p != part:
                levels = None  # not two at once
                part, levels = p, _Levels(counts, p, bits)
            level = levels.of(g)
            alone = int((level == 1).sum())
            last = prefix_length(len(g), s.percent)
            if alone >= last:
                continue
            order = np.lexsort((g, level))
            bits_ = np.zeros(map_words(len(g)), np.uint64)
            place = g % np.uint64(64 * len(bits_))
            np.bitwise_or.at(bits_, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
            out.append((doc, len(g), g[order[alone:last]].view(np.int64), np.arange(alone, last, dtype=np.int32), bits_.view(np.int64)))
            if len(out) >= 500:
                yield pd.DataFrame(out, columns=["rep", "n", "prefix", "pos", "bits"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["rep", "n", "prefix", "pos", "bits"])
        levels = out = None
        returned()

    return d.mapInPandas(run, "rep long, n int, prefix array<long>, pos array<int>, bits array<long>")


def _needed(x: Column, y: Column, percent: int) -> Column:
    """The least overlap of two sets of these sizes: ceil(p / (100 + p) * (x + y))."""
    return F.ceil((x + y) * percent / F.lit(float(100 + percent)) - 1e-9)


def _verified(pairs: DataFrame, docs: DataFrame, s: Settings, key: str, text: str) -> DataFrame:
    """Those pairs (a, b) of which the whole sets are similar enough, each looked at once."""
    percent, ids = s.percent, pairs.select(F.explode(F.array("a", "b")).alias(key)).distinct()
    some = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    sets = _sets(docs.join(some, key, "left_semi"), s, key, text)
    joined = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("y")), "b")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keep = []
            for x, y in zip(frame["x"], frame["y"], strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            yield frame.loc[keep, ["a", "b"]]
        frame = None
        returned()

    return joined.select("a", "b", "x", "y").mapInPandas(run, "a long, b long")


def link_components(docs: DataFrame, s: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id that links reach) of each row."""
    folder = shared_folder(docs.sparkSession)
    d = parts_of(docs.select(key, text)).select(F.col("__part").alias("part"), F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    bits = bucket_bits(text_bytes(d, "t"), BUCKET)
    signed = written(sizes(d, s), f"{folder}/sizes")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    classes = written(full.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "part")).alias("r")).select("c1", "c2", F.col("r.doc_id").alias("rep"), F.col("r.part").alias("part")), f"{folder}/classes")
    delivered(classes, f"{folder}/reps")
    known = d.where("k is not null")
    delivered(asked_counts(known, f"{folder}/reps", s, bits).groupBy("bucket").applyInPandas(_counted, "part long, bucket long, keys binary, level binary"), f"{folder}/counts")
    sets = written(prefixes(known, f"{folder}/reps", f"{folder}/counts", s, bits), f"{folder}/prefixes")
    maps = sets.select("rep", "n", "bits")

    # a star: each set meets the one of each n-gram that holds it earliest
    met = sets.select("rep", "n", F.explode(F.arrays_zip("prefix", "pos")).alias("p")).select(F.col("p.prefix").alias("gram"), F.col("p.pos").alias("pos"), "rep", "n")
    first = met.groupBy("gram").agg(F.min(F.struct("pos", "n", "rep")).alias("first"), F.count(F.lit(1)).alias("holders")).where("holders > 1").drop("holders")
    met = written(met.join(first, "gram"), f"{folder}/met")
    near = met.where(F.col("rep") != F.col("first.rep")).where(_near("n", "pos", "first.n", "first.pos", s.percent))
    stars = near.select(F.least("rep", "first.rep").alias("a"), F.greatest("rep", "first.rep").alias("b")).distinct()
    stars = written(_filtered(stars, maps, s), f"{folder}/pairs")
    links = written(_verified(stars, docs, s, key, text), f"{folder}/stars")
    found = components(links)

    # what the stars left apart, but for the pairs that they have tried
    tried = stars.select("a", "b", F.lit(True).alias("tried"))
    rest = _apart(met, found, s).withColumn("tried", F.lit(False)).unionByName(tried).groupBy("a", "b").agg(F.bool_or("tried").alias("tried"))
    rest = written(_filtered(rest.where("not tried").select("a", "b"), maps, s), f"{folder}/rest-pairs")
    more = written(_verified(rest, docs, s, key, text), f"{folder}/rest")
    final = found if more.isEmpty() else components(links.unionByName(more))

    labels = classes.join(final, classes["rep"] == final["node"], "left").select("c1", "c2", F.coalesce("component", "rep").alias("component_id"))
    # a class of very many rows stays where it is: its label is found for each part and class once
    wanted = full.select("part", "c1", "c2").distinct().join(labels, ["c1", "c2"])
    out = signed.join(wanted, ["part", "c1", "c2"], "left")
    return out.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _apart(met: DataFrame, found: DataFrame, s: Settings) -> DataFrame:
    """(a, b) of sets in different components: each meets those of other components than its n-gram's largest.

    A pair may come once for each n-gram it shares.
    """
    labelled = met.join(found, met["rep"] == found["node"], "left").select("gram", "rep", "n", "pos", F.coalesce("component", "rep").alias("c"))
    kinds = labelled.groupBy("gram", "c").agg(F.count(F.lit(1)).alias("k"))
    largest = kinds.groupBy("gram").agg(F.max(F.struct("k", "c")).alias("top"), F.count(F.lit(1)).alias("different")).where("different > 1").select("gram", F.col("top.c").alias("top"))
    open_ = labelled.join(largest, "gram")
    x, y = open_.where("c <> top").alias("x"), open_.alias("y")
    pairs = x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.c") != F.col("y.c")) & _near("x.n", "x.pos", "y.n", "y.pos", s.percent))
    return pairs.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))


def _near(n: str, p: str, m: str, q: str, percent: int) -> Column:
    """Length and positional filters: sizes n and m, places p and q of a shared n-gram.

    The n-gram is taken for the first that is shared, so nothing before it is common. A pair that is
    similar enough passes at its first one; at later ones it need not.
    """
    x, y, i, j = F.col(n), F.col(m), F.col(p), F.col(q)
    length = (x * 100 >= y * percent) & (y * 100 >= x * percent)
    return length & (F.least(x - i, y - j) >= _needed(x, y, percent))


def _filtered(pairs: DataFrame, maps: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a, b) that pass the suffix filter.

    Each bit that one set's map has and the other's has not is an n-gram at least that is not
    common, wherever in the order it stands; so the maps bound the overlap from above.
    """
    side = lambda k, n, bits: maps.select(F.col("rep").alias(k), F.col("n").alias(n), F.col("bits").alias(bits))
    p = pairs.join(side("a", "n", "p"), "a").join(side("b", "m", "q"), "b")

    # sets of near sizes have maps of the same or twice the words; the larger is folded to the smaller
    def folded(x: str, y: str) -> Column:
        half = (F.size(x) / 2).cast("int")
        halves = F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda u, v: u.bitwiseOR(v))
        return F.when(F.size(x) > F.size(y), halves).otherwise(F.col(x))

    p = p.withColumns({"p": folded("p", "q"), "q": folded("q", "p")})

    def alone(x: str, y: str) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda u, v: F.bit_count(u.bitwiseAND(F.bitwise_not(v)))), F.lit(0), lambda t, v: t + v)

    overlap = F.least(F.col("n") - alone("p", "q"), F.col("m") - alone("q", "p"))
    return p.where(overlap >= _needed(F.col("n"), F.col("m"), s.percent)).select("a", "b")


def _sets(docs: DataFrame, s: Settings, key: str, text: str) -> DataFrame:
    """(doc_id, grams): the sorted n-grams of each document as bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in chunked(frames, "t", 2_000_000):
            yield pd.DataFrame({"doc_id": frame["k"], "grams": [grams(h, s.words).tobytes() for _, h in words_of_texts(frame["t"].tolist())]})

    return mapped(docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")), run, "doc_id long, grams binary")


def without_near_copies(docs: DataFrame, s: Settings = Settings(5, 80), key: str = "doc_id") -> DataFrame:
    """docs of which one stays for each component: that with the least key; columns as they were.

    Rows without a key stay. Rows of one key belong together: if they differ in text each stays, of
    equal ones the first by all columns' hash does.
    """
    linked = link_components(docs.select(key, "text"), s, key)
    gone = linked.where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct()
    named = docs.where(F.col(key).isNotNull()).join(gone, key, "left_anti")
    # almost all keys have one row, so a count of keys decides which rows are compared at all
    again = named.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(key)
    once = named.join(again, key, "left_anti").select(*docs.columns)
    picked = F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("__row")
    first = named.join(again, key, "left_semi").groupBy(key, F.sha2(F.coalesce("text", F.lit("")), 256).alias("__text")).agg(picked).select("__row.*")
    return once.unionByName(first).unionByName(docs.where(F.col(key).isNull()))


def op8_jaccard(spark, sf_dir: str) -> DataFrame:
    return link_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

"""Language-model scores by a probabilistic suffix tree over words, beside a unigram base.

The tree's contexts are the last words of the text so far, up to `depth` words (the memory bound that
such trees have). It grows level by level: a context of any length is tested if it was met `least`
times in training, however much text there is, and whether or not its shorter one was kept (`steeper`
and `share` ask for more, where a caller wants a smaller tree). Its distribution is that of its followers, all of
them, smoothed towards the shorter context's by a weight; the weight is the one of a few under which
the followers, each left out of the counts in turn, are most probable. The context is kept if that
beats the shorter context's distribution by `evidence` bits. The followers of a context met more than
`common` times are dealt to several buckets, and no one of them sees all: each sums the bits of its own,
and the sums are put together before the test, which comes out as in one bucket. Each word is
scored by the longest kept context before it. The root is the unigram base, with one share for
unknown words. A text ends with an end token, and starts after a mark that contexts can hold.

Counts are of all training texts. The texts are read once and written as numbers of their words; they
are never shuffled: each part of the input sends its distinct words, or pairs of a tested context and a follower, as sorted arrays cut into buckets by
the hash of the context; a bucket sums them, tests its contexts, and sends back to each part what it
needs of them, as a table of its own in the shared folder. So the model is never broadcast, and no
task holds more of it than its part needs. Words are known by 64-bit hashes, and as followers by numbers
of their own, small for frequent words; those met once at most, and words beyond 31 bits of numbers, are told apart
after one context by 31 bits of their hashes.

Defined cases: null is empty, and an empty text has the end token alone; very long texts are read
whole; repeated rows count each time; with no training rows the base gives each token probability
1; an empty table gives an empty one; extra columns are ignored by score().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attest.llm.shared import bucket_bits, delivered, firsts, from_planes, grouped, mapped, mixed, packed, part_rows, parts_of, places, planes, returned, shared_folder, spans, unpacked, words_of_texts

END_WORD = np.uint64(0x8000000000000F0F)
#: Stands before each text's first word, as a context only.
START_WORD = np.uint64(0x7000000000000F0F)
#: Words and distinct pairs that a task counts at a time.
_WORDS, _PAIRS = 500_000, 1_500_000
#: Smoothing weights that a context chooses from.
WEIGHTS = (4.0, 16.0, 64.0, 256.0, 1024.0, 4096.0)
_NOT_KEPT = 255
#: Stands for the weight of a context whose followers are in several buckets.
_DEALT = 254
#: Bits of evidence are summed in whole parts of so much, so that sums don't depend on their order.
_STEPS = 1024
#: Bytes of text for each bucket.
BUCKET = 4 << 20


@dataclass(frozen=True)
class Settings:
    #: Words of the longest contexts.
    depth: int = 4
    #: Bits of evidence by which a context must diverge from the shorter one.
    evidence: float = 8.0
    #: Training occurrences of a tested context of one word; each word more needs `steeper` times as many.
    least: int = 8
    steeper: int = 1
    #: The share of all training tokens that a context of two words or more must have; 0 leaves none out.
    share: float = 0.0
    #: The followers of a context met more often are dealt to several buckets; results don't depend on it.
    common: int = 1 << 20

    def needed(self, level: int, tokens: int) -> int:
        """Occurrences of a tested context of `level` words among so many training tokens."""
        return self.least if level == 1 else max(self.least * self.steeper ** (level - 1), int(self.share * tokens))


def _hashed(older: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a context with one more word, of which the first 32 bits count."""
    return mixed(older * np.uint64(0x9E3779B97F4A7C15) + mixed(word >> np.uint64(32)))


def _rare(word: np.ndarray) -> np.ndarray:
    """The numbers of words that have none of their own, by their hashes."""
    return (word >> np.uint64(32)).astype(np.uint32) | np.uint32(1 << 31)


def _numbers(word: np.ndarray, n: np.ndarray, bits: int) -> np.ndarray:
    """The 32-bit numbers of all words of a bucket, by their counts: the most frequent ones have the smallest.

    The bucket stands in the last bits, so that no other bucket has them.
    """
    rank = np.empty(len(word), np.uint64)
    rank[np.argsort(-n, kind="stable")] = np.arange(len(word))
    own = (n > 1) & (rank < 1 << max(0, 31 - bits))
    return np.where(own, ((rank << np.uint64(bits)) | (word >> np.uint64(64 - bits))).astype(np.uint32), _rare(word))


def _zipped(x: np.ndarray) -> bytes:
    """The byte planes of numbers, compressed more than a shuffle does."""
    return pa.Codec("zstd", 1).compress(planes(x), asbytes=True)


def _unzipped(b: bytes, kind: type, size: int) -> np.ndarray:
    return from_planes(pa.Codec("zstd").decompress(b, size * np.dtype(kind).itemsize, asbytes=True), kind)


@dataclass
class _Chunk:
    """Some texts of one part as numbers of their words.

    words: the distinct words' hashes, then the start mark's; local: at each place the number of its
    word, each text with `depth` start marks before it; at: the places of words and end tokens; starts:
    where in at each text begins.
    """

    keys: list
    train: np.ndarray
    words: np.ndarray
    local: np.ndarray
    at: np.ndarray
    starts: np.ndarray

    def own(self) -> np.ndarray:
        """How often the chunk's training texts have each of its words."""
        n = np.bincount(self.local, weights=self.per_place(self.train), minlength=len(self.words)).astype(np.int64)
        n[-1] = self.train.sum()
        return n

    def per_place(self, of_text: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.local), of_text.dtype)
        out[self.at] = self.per_token(of_text)
        return out

    def per_token(self, of_text: np.ndarray) -> np.ndarray:
        return np.repeat(of_text, np.diff(np.append(self.starts, len(self.at))))


_CHUNK = "part long, keys array<{}>, train binary, sizes binary, ids binary, words binary"


def tokenised(docs: DataFrame, key: str, text: str, train: Column, folder: str) -> DataFrame:
    """The texts of each part in chunks of some hundred thousand words, as numbers of each chunk's own words, written once."""
    kind, end = docs.schema[key].dataType.simpleString(), np.array([END_WORD])

    def made(part: int, keys: list, train: np.ndarray, held: list[np.ndarray]) -> pd.DataFrame:
        ended = [x for h in held for x in (h, end)]
        every = np.concatenate(ended)
        one, ids = grouped(every)
        sizes = np.array([len(h) + 1 for h in held], np.int32)
        return pd.DataFrame([{"part": part, "keys": keys, "train": train.tobytes(), "sizes": sizes.tobytes(), "ids": planes(ids.astype(np.uint32)), "words": packed(every[one])}])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keys, trains = frame["k"].tolist(), frame["train"].to_numpy(bool)
            for a, z in spans(frame["part"].to_numpy()):
                part, held, first, size = int(frame["part"].iat[a]), [], a, 0
                for i, h in words_of_texts(frame["t"].iloc[a:z].tolist()):
                    if held and size + len(h) > _WORDS:
                        yield made(part, keys[first : a + i], trains[first : a + i], held)
                        held, first, size = [], a + i, 0
                    held.append(h)
                    size += len(h) + 1
                if held:
                    yield made(part, keys[first:z], trains[first:z], held)

    d = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.coalesce(train, F.lit(False)).alias("train"))
    d = parts_of(d).withColumnRenamed("__part", "part")
    schema = _CHUNK.format(kind)
    mapped(d, run, schema).write.option("compression", "zstd").parquet(f"{folder}/chunks")
    return docs.sparkSession.read.schema(schema).parquet(f"{folder}/chunks")


def _chunks(frames: Iterator[pd.DataFrame], depth: int) -> Iterator[tuple[int, _Chunk]]:
    for frame in frames:
        for row in frame.itertuples():
            words = np.append(unpacked(row.words, np.uint64), START_WORD)
            sizes = np.frombuffer(row.sizes, np.int32).astype(np.int64)
            starts = np.cumsum(sizes) - sizes
            ids = from_planes(row.ids, np.uint32)
            at = np.arange(len(ids)) + depth * np.repeat(np.arange(1, len(sizes) + 1), sizes)
            local = np.full(len(ids) + depth * len(sizes), len(words) - 1, np.int64)
            local[at] = ids
            yield int(row.part), _Chunk(list(row.keys), np.frombuffer(row.train, bool), words, local, at, starts)


class _Words:
    """The training counts and numbers of one part's words."""

    def __init__(self, folder: str, part: int) -> None:
        keys, n, number = part_rows(f"{folder}/level0", part, ["keys", "n", "numbers"])
        if not len(keys):
            raise ValueError(f"no word counts came back for part {part}")
        key = np.concatenate([unpacked(k, np.uint64) for k in keys])
        order = np.argsort(key, kind="stable")
        self.key, self.n = key[order], np.append(np.concatenate([from_planes(x, np.uint64) for x in n])[order].astype(np.int64), 0)
        self.number = np.append(np.concatenate([from_planes(x, np.uint32) for x in number])[order], np.uint32(0))

    def count(self, chunk: _Chunk) -> tuple[np.ndarray, np.ndarray]:
        """The count and the number of each of a chunk's words; one that did not come back has no count but the chunk's own, if any."""
        at = places(self.key, chunk.words)
        return np.where(at >= 0, self.n[at], chunk.own()), np.where(at >= 0, self.number[at], _rare(chunk.words))


class _Level:
    """What one part got back of a level: contexts with the weights of kept ones, and counts of their followers."""

    def __init__(self, folder: str, part: int, level: int) -> None:
        context, weight, sizes, word, n = part_rows(f"{folder}/level{level}", part, ["contexts", "weight", "sizes", "words", "n"])
        join = lambda x, kind: np.concatenate([np.zeros(0, kind), *x])
        c = join([unpacked(x, np.uint64) for x in context], np.uint64)
        w = join([np.frombuffer(x, np.uint8) for x in weight], np.uint8)
        size = join([from_planes(x, np.uint32) for x in sizes], np.uint32).astype(np.int64)
        word = join([from_planes(x, np.uint32) for x in word], np.uint32).astype(np.uint64)
        # a common context comes from several buckets, and a part that two tasks asked for from each twice
        self.asked = len(context) > 0
        self.context, first, number = np.unique(c, return_index=True, return_inverse=True)
        w[first] = _settled(f"{folder}/common{level}", self.context, w[first])
        self.weight = np.append(np.append(np.array(WEIGHTS), 0.0)[np.minimum(w[first], len(WEIGHTS))], 0.0)
        pair = (np.repeat(number.astype(np.uint64), size) << np.uint64(32)) | word
        order = np.argsort(pair)
        self.pair, self.n = pair[order], np.append(join([from_planes(x, np.uint64) for x in n], np.uint64)[order].astype(np.int64), 0)
        self.next = np.full(len(self.pair) + 1, -1)

    def longer(self, at: np.ndarray) -> np.ndarray:
        """The contexts of one word more that the pairs at those places are."""
        pair = self.pair[at]
        return _hashed(self.context[(pair >> np.uint64(32)).astype(np.int64)], pair << np.uint64(32))

    def followed(self, level: "_Level", needed: int) -> None:
        """Finds the contexts of the next level once for all chunks: those are pairs of this one that are met often enough."""
        often = np.flatnonzero(self.n[:-1] >= needed)
        self.next[often] = places(level.context, self.longer(often))

    def count(self, place: np.ndarray, word: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often training has the words after the contexts at those places (-1: none), and where those pairs are (-1: nowhere).

        A pair that did not come back was met by training once at most: there, if it is of a training text.
        """
        out, at = np.zeros(len(place), np.int64), np.full(len(place), -1)
        known = np.flatnonzero(place >= 0)
        pair = (place[known].astype(np.uint64) << np.uint64(32)) | (word[known] >> np.uint64(32))
        at[known] = found = places(self.pair, pair)
        out[known] = np.where(found >= 0, self.n[found], train[known])
        return out, at


def _levels(folder: str, part: int, depth: int, s: "Settings", tokens: int) -> list[_Level]:
    """What one part got back of the first levels."""
    levels = [_Level(folder, part, k) for k in range(1, depth + 1)]
    for k, (level, after) in enumerate(zip(levels, levels[1:]), 2):
        level.followed(after, s.needed(k, tokens))
    return levels


def _settled(path: str, context: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The weights of sorted contexts once those of dealt ones, which are few, are looked up."""
    dealt = np.flatnonzero(weight == _DEALT)
    if len(dealt):
        known, of = part_rows(path, 0, ["context", "weight"])
        order = np.argsort(known.view(np.uint64))
        at = places(known.view(np.uint64)[order], context[dealt])
        if (at < 0).any():
            raise ValueError("a context whose followers were dealt was not tested")
        weight = weight.copy()
        weight[dealt] = of[order][at]
    return weight


@dataclass
class _Walk:
    """Where a chunk's words stand after some levels: for the words at `open`, contexts of one level more may be tested.

    count: training counts of all words; share: probabilities by the levels so far; open: places in at;
    met: how often training has their contexts; pair: where the last level has those as pairs, if there is one;
    number: the numbers of the chunk's words.
    """

    count: np.ndarray
    number: np.ndarray
    share: np.ndarray
    open: np.ndarray
    met: np.ndarray
    pair: np.ndarray | None = None

    def context(self, chunk: _Chunk, levels: list[_Level]) -> np.ndarray:
        """The contexts' hashes."""
        return chunk.words[chunk.local[chunk.at[self.open] - 1]] if self.pair is None else levels[-1].longer(self.pair)


def _walked(chunk: _Chunk, words: _Words, levels: list[_Level], s: "Settings", tokens: int, whole: float) -> _Walk:
    """Follows each word's contexts through the levels. A longer context is looked at only where the shorter was met often enough."""
    (of_word, number), at, train = words.count(chunk), chunk.at, chunk.per_token(chunk.train)
    count, before = of_word[chunk.local[at]], chunk.local[at - 1]
    share = (count + 1.0) / whole
    open_ = np.flatnonzero(of_word[before] >= s.needed(1, tokens))
    walk = _Walk(count, number, share, open_, of_word[before[open_]])
    for k, level in enumerate(levels, 1):
        if len(walk.open) and not level.asked:
            raise ValueError(f"no counts of level {k} came back for a part that asked")
        if k == 1:  # contexts are words, each looked up once
            place = places(level.context, chunk.words)[before[walk.open]]
        else:
            place = levels[k - 2].next[walk.pair]
        word = number[chunk.local[at[walk.open]]].astype(np.uint64) << np.uint64(32)
        (n, pair), weight = level.count(place, word, train[walk.open]), level.weight[place]
        old = share[walk.open]
        share[walk.open] = np.where(weight > 0, (n + weight * old) / (walk.met + weight), old)
        # the context of one word more is this one and its follower, where both stand before a word
        often = n >= s.needed(k + 1, tokens)
        where, met, longer = walk.open[often], n[often], pair[often]
        within = where + 1 < len(at)
        within[within] = at[where[within] + 1] == at[where[within]] + 1
        walk = _Walk(count, number, share, where[within] + 1, met[within], longer[within])
    return walk


def _with_flag(inverse: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """Sums of counts that carry a flag in their last bit, which is set if any is."""
    total = np.bincount(inverse, weights=n >> 1, minlength=size).astype(np.int64)
    return 2 * total + (np.bincount(inverse, weights=n & 1, minlength=size) > 0)


def _to_send(n: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which sums a part can't tell: those of two and more, and one where the part has it elsewhere than in a training text alone."""
    return (n > 1) | ((n == 1) & (own != 2))


def asked_words(d: DataFrame, bits: int) -> DataFrame:
    """(part, bucket, keys, n): the words of each part, in buckets by hash.

    n is twice how often the part's training texts have a word, and one more if other texts of it do.
    """

    def blocks(part: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
        word, n = (np.concatenate(x) for x in zip(*held, strict=True))
        one, inverse = grouped(word)
        u, n = word[one], _with_flag(inverse, n, len(one)).astype(np.uint64)
        bucket = (u >> np.uint64(64 - bits)).astype(np.int64)
        cut = spans(bucket)
        return pd.DataFrame({"part": np.int64(part), "bucket": bucket[[a for a, _ in cut]], "keys": [packed(u[a:z]) for a, z in cut], "n": [planes(n[a:z]) for a, z in cut]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held, size = None, [], 0
        for p, chunk in _chunks(frames, 0):
            if held and p != part:
                yield blocks(part, held)
                held, size = [], 0
            part = p
            n = 2 * chunk.own() + (np.bincount(chunk.local, weights=chunk.per_place(~chunk.train), minlength=len(chunk.words)) > 0)
            held.append((chunk.words, n))
            size += len(n)
            if size > _PAIRS:
                yield blocks(part, held)
                held, size = [], 0
        if held:
            yield blocks(part, held)
        held = None
        returned()

    return d.mapInPandas(run, "part long, bucket long, keys binary, n binary")


def _summed(bits: int):
    """For one bucket of words, the sums over all parts and the words' numbers, for each part; tokens and words of the bucket in one row."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        arrays = [unpacked(k, np.uint64) for k in rows["keys"]]
        word = np.concatenate(arrays)
        u, inverse = np.unique(word, return_inverse=True)
        own = np.concatenate([from_planes(x, np.uint64) for x in rows["n"]]).astype(np.int64)
        # whole numbers, which floats would round
        n = np.zeros(len(u), np.int64)
        np.add.at(n, inverse, own >> 1)
        counted = (n > 0) & (u != START_WORD)
        tokens, words = int(n[counted].sum()), int(counted.sum())
        ends, number = np.cumsum([len(a) for a in arrays]), _numbers(u, n, bits)
        out = []
        for i, (part, z, a) in enumerate(zip(rows["part"], ends, arrays, strict=True)):
            mine = slice(z - len(a), z)
            told = n[inverse[mine]]
            sent = _to_send(told, own[mine])
            out.append({"part": part, "keys": packed(a[sent]), "n": planes(told[sent].astype(np.uint64)), "numbers": planes(number[inverse[mine][sent]]), "tokens": 0 if i else tokens, "words": 0 if i else words})
        return pd.DataFrame(out)

    return run


def asked_pairs(d: DataFrame, level: int, s: Settings, bits: int, folder: str, tokens: int, whole: float) -> DataFrame:
    """(part, bucket, contexts, common, sizes, words, share, n): followers of each part's tested contexts of `level` words.

    share is the follower's probability by the levels before in eighths of a bit (up to 255), for the
    test alone; n is as that of asked_words().
    """

    def blocks(part: int, held: list[tuple[np.ndarray, ...]]) -> Iterator[pd.DataFrame]:
        context, word, share, deals, n = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        # a common context's followers are dealt to several buckets, by the followers
        home = np.where(deals > 1, mixed(context + mixed(word.astype(np.uint64)) % deals), context) if (deals > 1).any() else context
        # by context, and there by follower: equal pairs from several chunks meet
        _, number = grouped(home)
        order, inverse = grouped((number.astype(np.uint64) << np.uint64(32)) | word)
        total, home = _with_flag(inverse, n, len(order)).astype(np.uint32), home[order]
        context, word, share, common = context[order], word[order], share[order], (deals > 1)[order]
        bucket = (home >> np.uint64(64 - bits)).astype(np.int64)
        cut = spans(bucket)
        for i in range(0, len(cut), 256):
            out = []
            for a, z in cut[i : i + 256]:
                at = firsts(home[a:z])
                out.append({"part": part, "bucket": bucket[a], "contexts": packed(context[a:z][at]), "common": common[a:z][at].tobytes(), "sizes": planes(np.diff(np.append(at, z - a)).astype(np.uint32)), "words": _zipped(word[a:z]), "share": _zipped(share[a:z]), "n": _zipped(total[a:z])})
            yield pd.DataFrame(out)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held, size = None, [], 0
        for p, chunk in _chunks(frames, 1):
            if p != part:
                if held:
                    yield from blocks(part, held)
                held, size, part, words, levels = [], 0, p, None, None
                returned()
                words, levels = _Words(folder, p), _levels(folder, p, level - 1, s, tokens)
            walk = _walked(chunk, words, levels, s, tokens, whole)
            if not len(walk.open):
                continue
            own = chunk.local[chunk.at[walk.open]]
            context = walk.context(chunk, levels)
            one, inverse = grouped((context ^ (context >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + own.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            mine = chunk.per_token(chunk.train)[walk.open]
            n = _with_flag(inverse, np.where(mine, 2, 1), len(one)).astype(np.uint32)
            eighths = np.minimum(-np.log2(walk.share[walk.open[one]]) * 8, 255).astype(np.uint8)
            deals = np.where(walk.met[one] > s.common, walk.met[one] // s.common + 1, 1).astype(np.uint32)
            held.append((context[one], walk.number[own[one]], eighths, deals, n))
            size += len(one)
            if size > _PAIRS:
                yield from blocks(part, held)
                held, size = [], 0
        if held:
            yield from blocks(part, held)
        words = levels = held = None
        returned()

    return d.mapInPandas(run, "part long, bucket long, contexts binary, common binary, sizes binary, words binary, share binary, n binary")


def _tested(longer: int, evidence: float):
    """For one bucket, the weight of each kept context, and the counts that its parts need.

    Those are the counts of kept contexts' followers, and of pairs met often enough to be a context.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        contexts, sizes = [unpacked(x, np.uint64) for x in rows["contexts"]], [from_planes(x, np.uint32).astype(np.int64) for x in rows["sizes"]]
        pairs = [int(x.sum()) for x in sizes]
        unzipped = lambda name, kind: np.concatenate([_unzipped(x, kind, k) for x, k in zip(rows[name], pairs, strict=True)])
        own, number = np.unique(np.concatenate(contexts), return_inverse=True)
        word = unzipped("words", np.uint32)
        common = np.concatenate([np.repeat(np.frombuffer(x, bool), b) for x, b in zip(rows["common"], sizes, strict=True)])
        share, n = unzipped("share", np.uint8), unzipped("n", np.uint32).astype(np.int64)
        of_pair = np.repeat(number, np.concatenate(sizes))
        first, pair = grouped((of_pair.astype(np.uint64) << np.uint64(32)) | word)
        total = np.bincount(pair, weights=n >> 1).astype(np.int64)
        of = of_pair[first]
        p = np.exp2(share[first] / -8.0)
        met = np.bincount(of, weights=total)
        steps = np.zeros((len(own), len(WEIGHTS)))
        for i, w in enumerate(WEIGHTS):
            left_out = np.where(total > 0, total * np.log2((np.maximum(total, 1) - 1 + w * p) / p), 0.0)
            steps[:, i] = np.bincount(of, weights=np.rint(left_out * _STEPS), minlength=len(own))
        weight = _weights(met, steps, evidence)
        dealt = common[first[firsts(of)]]
        weight[dealt] = _DEALT
        needed = (total > 0) & ((weight[of] != _NOT_KEPT) | (total >= longer))
        out, z = [], 0
        if dealt.any():  # in a row of no part
            sums = np.column_stack([met, steps])[dealt].astype(np.int64)
            out.append({"part": None, "contexts": own[dealt].tobytes(), "weight": b"", "sizes": b"", "words": b"", "n": sums.tobytes()})
        for part, a, b, k in zip(rows["part"], contexts, sizes, pairs, strict=True):
            mine = pair[z : z + k]
            z += len(mine)
            hit = needed[mine] & _to_send(total[mine], n[z - len(mine) : z])
            kind = weight[of[mine[np.cumsum(b) - b]]]
            left = np.add.reduceat(hit.astype(np.int64), np.cumsum(b) - b)
            some = (kind != _NOT_KEPT) | (left > 0)
            out.append({"part": part, "contexts": packed(a[some]), "weight": kind[some].tobytes(), "sizes": planes(left[some].astype(np.uint32)), "words": planes(word[first][mine[hit]]), "n": planes(total[mine[hit]].astype(np.uint64))})
        made = pd.DataFrame(out, columns=["part", "contexts", "weight", "sizes", "words", "n"])
        made["part"] = pd.array([x["part"] for x in out], "Int64")  # without doubles, as one may be null
        returned()
        return made

    return run


def _weights(met: np.ndarray, steps: np.ndarray, evidence: float) -> np.ndarray:
    """The place in WEIGHTS of each context's best weight, or _NOT_KEPT.

    met: how often each was met; steps: for each weight, its followers' bits, as _STEPS counts them.
    """
    best, weight = np.full(len(met), -np.inf), np.zeros(len(met), np.uint8)
    for i, w in enumerate(WEIGHTS):
        bits = steps[:, i] / _STEPS - met * np.log2(np.maximum(met - 1 + w, 1e-9))
        better = bits > best
        best[better], weight[better] = bits[better], i
    weight[best < evidence] = _NOT_KEPT
    return weight


def _common(spark: SparkSession, folder: str, level: int, evidence: float) -> None:
    """Tests the contexts whose followers went to several buckets, by the sums of those."""
    names = ["met", *(f"s{i}" for i in range(len(WEIGHTS)))]

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            context = np.frombuffer(b"".join(frame["contexts"]), np.int64)
            yield pd.DataFrame({"context": context} | dict(zip(names, np.frombuffer(b"".join(frame["n"]), np.int64).reshape(-1, len(names)).T, strict=True)))

    def tested(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"part": 0, "context": frame["context"], "weight": _weights(frame["met"].to_numpy(), frame[names[1:]].to_numpy(np.float64), evidence).astype(np.int32)})

    rows = spark.read.schema("part long, contexts binary, n binary").parquet(f"{folder}/level{level}").where("part is null")
    if not rows.isEmpty():
        sums = rows.select("contexts", "n").mapInPandas(each, "context long, " + ", ".join(f"{x} long" for x in names))
        sums = sums.groupBy("context").agg(*[F.sum(x).alias(x) for x in names])
        sums.mapInPandas(tested, "part long, context long, weight int").write.partitionBy("part").parquet(f"{folder}/common{level}")


def grow(d: DataFrame, s: Settings, folder: str) -> tuple[int, int, int]:
    """Counts and tests all levels of d, the tokenised texts, and delivers them; gives training tokens, vocabulary and depth."""
    spark = d.sparkSession
    bits = bucket_bits(d.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0))).first()[0], BUCKET)
    delivered(asked_words(d, bits).groupBy("bucket").applyInPandas(_summed(bits), "part long, keys binary, n binary, numbers binary, tokens long, words long"), f"{folder}/level0")
    sums = spark.read.schema("part long, tokens long, words long").parquet(f"{folder}/level0")
    tokens, vocabulary = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    whole, level = tokens + vocabulary + 1.0, 0
    while level < s.depth:
        level += 1
        told = asked_pairs(d, level, s, bits, folder, tokens, whole).groupBy("bucket").applyInPandas(_tested(s.needed(level + 1, tokens), s.evidence), "part long, contexts binary, weight binary, sizes binary, words binary, n binary")
        delivered(told, f"{folder}/level{level}")
        _common(spark, folder, level, s.evidence)
        if spark.read.schema("part long, contexts binary").parquet(f"{folder}/level{level}").where("length(contexts) > 0").isEmpty():
            return tokens, vocabulary, level - 1
    return tokens, vocabulary, level


def score(docs: DataFrame, train: Column, s: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score and score of each row."""
    folder = shared_folder(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    d = tokenised(docs, key, text, train, folder)
    tokens, vocabulary, depth = grow(d, s, folder)
    whole = tokens + vocabulary + 1.0

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = None
        for p, chunk in _chunks(frames, 1):
            if p != part:
                words = levels = None
                returned()
                part, words, levels = p, _Words(folder, p), _levels(folder, p, depth, s, tokens)
            walk = _walked(chunk, words, levels, s, tokens, whole)
            count, share, sums = walk.count, walk.share, lambda x: np.add.reduceat(x, chunk.starts)
            out = {"n_tokens": np.diff(np.append(chunk.starts, len(chunk.at))), "n_known": sums((count > 0).astype(np.int64)), "train_tokens": tokens}
            yield pd.DataFrame({"doc_id": pd.Series(chunk.keys, dtype=object), "train": chunk.train} | out | {"base_score": sums(np.log10((count + 1.0) / whole)), "score": sums(np.log10(share))})

    return mapped(d, run, f"doc_id {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op5_suffix_tree(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return score(docs, ~held_out).select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

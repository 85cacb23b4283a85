"""Removal of byte strings that repeat from earlier documents, by a logarithmic family of suffix arrays.

Suffixes are sampled: every 50-byte window has an anchor, the place in it whose next 16 bytes have
the least hash, so two equal windows sample the same suffix. Documents come in batches by rising
doc_id. The suffix array of a batch holds its sampled suffixes in the order of the hash of their
first 16 bytes, cut into buckets of that hash; each part of the input sends its own sorted array, and
a bucket merges them. The batch's array is merge-scanned against the arrays of the existing levels.
A suffix that starts alike in two documents is a lead, for the later document as for the earlier one.
Then the batch becomes a level, and as long as two levels have as many batches they merge.

Leads only name the places where a match of 50 bytes may be. There, each part sends the bytes around
the suffix (a run: neighbouring windows with one anchor), each distinct run once with the least
doc_id that has it. Runs of one suffix meet in a bucket, where the bytes of their windows are sorted
and compared, and each window gets the least doc_id that has it. A window is removed from every
larger doc_id. Windows of a suffix that very many documents have are dealt by their own hash
instead, so that one bucket does not gather every text around a common passage.

Defined cases: null is empty; texts under 50 bytes lose nothing; very long texts are read whole;
rows with equal doc_id never remove bytes from each other; rows without a doc_id come after all
others; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.llm.shared import block_hashes, bucket_bits, delivered, firsts, hashed_blocks, mixed, packed, part_rows, parts_of, places, runs_of_texts, shared_folder, spans, text_bytes, unpacked, written

LENGTH = 50
ANCHOR = 16
#: Windows of a run at most, and the bytes they cover.
SPAN = LENGTH - ANCHOR + 1
REACH = LENGTH + SPAN - 1
LAST = (1 << 63) - 1
_BYTES = mixed(np.arange(256, dtype=np.uint64) + np.uint64(0xB17E5))
_STEP = {s: np.uint64(int(mixed(np.array([s], np.uint64))[0]) | 1) for s in (1, 2, 4, 8, 16, 32)}
_ODD = mixed(np.arange(1, 8, dtype=np.uint64)) | np.uint64(1)


@dataclass(frozen=True)
class Settings:
    #: Batches that documents come in, by ranges of doc_id with about as many documents.
    batches: int = 4
    #: Bytes of text for each bucket.
    bucket: int = 4 << 20
    #: A suffix of more documents than this deals its windows by their own hash.
    common: int = 16_384


def window_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each 50-byte window, hash of its anchor), for windows in order of their start."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    power = {1: _BYTES[data]}
    for s in (1, 2, 4, 8, 16):
        h = power[s]
        power[2 * s] = h[: len(h) - s] * _STEP[s] + h[s:]
    # 50 = 32 + 16 + 2
    window = (power[32][:n] * _STEP[16] + power[16][32 : 32 + n]) * _STEP[2] + power[2][48 : 48 + n]
    least = mixed(power[ANCHOR])
    size = 1
    while 2 * size <= SPAN:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    least = np.minimum(least[:n], least[SPAN - size : SPAN - size + n])
    # the least of many hashes is small; mixing spreads it over the buckets
    return mixed(window), mixed(least)


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, hash, hash of the anchor, number of the text) of the windows inside the texts of a buffer.

    A text ends one byte before the next begins.
    """
    window, anchor = window_hashes(data)
    counts = np.maximum(np.diff(offsets) - LENGTH, 0)
    at = _ragged(offsets[:-1], counts)
    return at, window[at], anchor[at], np.repeat(np.arange(len(counts)), counts)


def runs(window: np.ndarray, anchor: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the runs of windows of one text with one anchor, of SPAN windows at most.

    First and last window of a run overlap, so their hashes and the length stand for all its bytes.
    """
    n = len(anchor)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    change = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(change)
    lengths = np.diff(np.append(first, n))
    if lengths.max() > SPAN:
        change |= (np.arange(n) - np.repeat(first, lengths)) % SPAN == 0
        first = np.flatnonzero(change)
    ends = np.append(first[1:], n)
    return first, ends, mixed(window[first] * np.uint64(0x9E3779B97F4A7C15) + mixed(window[ends - 1]) + (ends - first).astype(np.uint64))


#: Bytes of texts that are hashed at a time.
_BUFFER = 300_000


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... of all i, counts[i] each."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(counts.sum())


def suffixes(docs: DataFrame, bits: int) -> DataFrame:
    """(part, bucket, keys, held) of docs(part, doc, t): each part's sampled suffixes in order.

    bucket has the first bits of a suffix's hash, keys the next 32 as sorted numbers, held in how many
    documents of the part each was (up to 65535).
    """

    def blocks(part: int, parts: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        k = np.concatenate(parts)
        k.sort()
        at = firsts(k)
        held = np.minimum(np.diff(np.append(at, len(k))), 65535).astype(np.uint16)
        k = k[at]
        yield hashed_blocks(part, k, bits, held=held)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, kept, size = None, [], 0
        for frame in frames:
            for a, z in spans(frame["part"].to_numpy()):
                p = int(frame["part"].iat[a])
                for _, _, data, offsets in runs_of_texts(frame["t"].iloc[a:z].tolist(), _BUFFER):
                    if kept and (p != part or size > 2_000_000):
                        yield from blocks(part, kept)
                        kept, size = [], 0
                    part = p
                    _, _, anchor, text = windows_of(data, offsets)
                    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])) if len(anchor) else np.zeros(0, np.int64)
                    anchor, text = anchor[new], text[new]
                    order = np.lexsort((anchor, text))
                    anchor, text = anchor[order], text[order]
                    if len(anchor):  # each text's anchors once
                        own = anchor[np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])]
                        kept.append(own)
                        size += len(own)
        if kept:
            yield from blocks(part, kept)

    return docs.select("part", "t").mapInPandas(run, "part long, bucket long, keys binary, held binary")


_ARRAY = "bucket long, keys binary, codes binary, parts binary"


class SuffixIndex:
    """Levels of suffix arrays in the shared folder; level i holds 2**i batches.

    A level has a row for each bucket: its keys in order, and for each key the part of the input that
    had it first (a code in the list of parts).
    """

    def __init__(self, spark, bits: int) -> None:
        self.spark, self.bits, self.folder = spark, bits, shared_folder(spark)
        self.levels: dict[int, DataFrame] = {}
        self.waiting: DataFrame | None = None
        self.count = 0

    def add(self, docs: DataFrame) -> DataFrame:
        """Leads (part, bucket, keys, held) of a batch of docs(part, doc, t) against itself and all levels."""
        self._settle()
        levels = None
        for level in self.levels.values():
            levels = level if levels is None else levels.unionByName(level)
        if levels is None:
            levels = self.spark.createDataFrame([], _ARRAY)
        fresh = suffixes(docs, self.bits)
        at = f"{self.folder}/batch{self.count}"
        self.count += 1
        found = written(fresh.groupBy("bucket").cogroup(levels.groupBy("bucket")).applyInPandas(_scanned, f"lead boolean, part long, held binary, {_ARRAY}"), at)
        self.waiting = found.where("not lead").select("bucket", "keys", "codes", "parts")
        return found.where("lead").select("part", "bucket", "keys", "held")

    def _settle(self) -> None:
        """Makes the last batch a level, and merges levels of equal size."""
        if self.waiting is None:
            return
        level, new = 0, self.waiting
        while level in self.levels:
            both = self.levels.pop(level).withColumn("age", F.lit(0)).unionByName(new.withColumn("age", F.lit(1)))
            new = both.groupBy("bucket").applyInPandas(_merged, _ARRAY)
            level += 1
        self.levels[level] = written(new, f"{self.folder}/level{level}-{self.count}") if level else new
        self.waiting = None


def _array(bucket: int, keys: np.ndarray, owner: np.ndarray) -> dict:
    """A bucket of a suffix array: sorted keys and the part that each is from."""
    parts, codes = np.unique(owner, return_inverse=True)
    codes = codes.astype(np.uint8 if len(parts) < 256 else np.uint32)
    return {"bucket": bucket, "keys": packed(keys), "codes": codes.tobytes(), "parts": parts.tobytes()}


def _read(row) -> tuple[np.ndarray, np.ndarray]:
    """(keys, parts) of a bucket of a level."""
    parts = np.frombuffer(row.parts, np.int64)
    return unpacked(row.keys), parts[np.frombuffer(row.codes, np.uint8 if len(parts) < 256 else np.uint32)]


def _scanned(key: tuple, fresh: pd.DataFrame, levels: pd.DataFrame) -> pd.DataFrame:
    """One bucket: the batch's own array, and the leads of parts of the batch and of the levels."""
    bucket, out = int(key[0]), []
    if fresh.empty:
        return pd.DataFrame(columns=["lead", "part", "held", "bucket", "keys", "codes", "parts"])
    arrays = [unpacked(k) for k in fresh["keys"]]
    k = np.concatenate(arrays)
    held = np.concatenate([np.frombuffer(x, np.uint16) for x in fresh["held"]])
    owner = np.repeat(fresh["part"].to_numpy(np.int64), [len(a) for a in arrays])
    order = np.argsort(k, kind="stable")
    k, held, owner = k[order], held[order], owner[order]
    first = firsts(k)
    times = np.diff(np.append(first, len(k)))
    lead = np.add.reduceat(held.astype(np.int64), first) > 1
    own = k[first]
    out.append(_array(bucket, own, owner[first]) | {"lead": False, "part": 0})  # no null here: pandas would make the parts floats
    for row in levels.itertuples():
        keys, parts = _read(row)
        at = np.searchsorted(keys, own)
        at[at == len(keys)] = 0
        met = keys[at] == own
        lead |= met
        out += _by_part(bucket, keys[at[met]], parts[at[met]], np.ones(int(met.sum()), np.uint16))
    hit = np.repeat(lead, times)
    out += _by_part(bucket, k[hit], owner[hit], held[hit])
    return pd.DataFrame(out, columns=["lead", "part", "held", "bucket", "keys", "codes", "parts"])


def _by_part(bucket: int, keys: np.ndarray, part: np.ndarray, held: np.ndarray) -> list[dict]:
    order = np.argsort(part, kind="stable")
    keys, part, held = keys[order], part[order], held[order]
    return [{"lead": True, "part": int(part[a]), "bucket": bucket, "keys": packed(keys[a:z]), "held": held[a:z].tobytes()} for a, z in spans(part)]


def _merged(key: tuple, both: pd.DataFrame) -> pd.DataFrame:
    """One bucket of two levels as one; a key that both have stays with the older."""
    read = [_read(row) for row in both.sort_values("age").itertuples()]
    keys, parts = (np.concatenate(x) for x in zip(*read, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, parts = keys[order], parts[order]
    first = firsts(keys)
    return pd.DataFrame([_array(int(key[0]), keys[first], parts[first])])


def _leads(common: int):
    """For one bucket, each part's leads once, with those of more than `common` documents marked."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        arrays = [unpacked(k) for k in rows["keys"]]
        k = np.concatenate(arrays)
        held = np.concatenate([np.frombuffer(x, np.uint16) for x in rows["held"]]).astype(np.int64)
        part = np.repeat(rows["part"].to_numpy(np.int64), [len(a) for a in arrays])
        order = np.lexsort((k, part))
        u, inverse = np.unique(k, return_inverse=True)
        many = (np.bincount(inverse, weights=held, minlength=len(u)) > common)[inverse]
        k, part, many = k[order], part[order], many[order]
        once = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (part[1:] != part[:-1])]))
        k, part, many = k[once], part[once], many[once]
        cut = spans(part)
        return pd.DataFrame({"part": part[[a for a, _ in cut]], "bucket": int(key[0]), "keys": [packed(k[a:z]) for a, z in cut], "many": [many[a:z].tobytes() for a, z in cut]})

    return run


def _leads_of(folder: str, part: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(first bits + 32 of the hashes of a part's leads in order, which of them are of many documents)."""
    bucket, keys, many = part_rows(folder, part, ["bucket", "keys", "many"])
    if not len(bucket):
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    full = block_hashes(bucket, keys)
    order = np.argsort(full)
    return full[order], np.concatenate([np.frombuffer(m, bool) for m in many])[order]


def _lead_runs(data: np.ndarray, offsets: np.ndarray, leads: tuple[np.ndarray, np.ndarray], bits: int) -> tuple[np.ndarray, ...]:
    """(start, windows, bucket hash, run hash, number of the text) of the runs at leads; those of many documents window by window."""
    at, window, anchor, text = windows_of(data, offsets)
    a, z, h = runs(window, anchor, text)
    key = anchor[a]
    found = places(leads[0], key >> np.uint64(32 - bits))
    hit = found >= 0
    many = hit.copy()
    many[hit] = leads[1][found[hit]]
    single = hit & ~many
    alone = _ragged(a[many], (z - a)[many]) if many.any() else np.zeros(0, np.int64)
    own = mixed(window[alone] + np.uint64(1))
    return np.concatenate([at[a[single]], at[alone]]), np.concatenate([(z - a)[single], np.ones(len(alone), np.int64)]), np.concatenate([key[single], own]), np.concatenate([h[single], window[alone]]), np.concatenate([text[a[single]], text[alone]])


def lead_runs(docs: DataFrame, folder: str, bits: int) -> DataFrame:
    """(part, bucket, keys, hashes, least, most, size, bytes) of docs(part, doc, t): each part's distinct runs at leads."""

    def blocks(part: int, kept: list[tuple[np.ndarray, ...]]) -> Iterator[pd.DataFrame]:
        key, h, doc, size, text = (np.concatenate(x) for x in zip(*kept, strict=True))
        order = np.lexsort((doc, h, key))
        key, h, doc, size, text = key[order], h[order], doc[order], size[order], text[order]
        at = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (h[1:] != h[:-1])]))
        least, most = doc[at], doc[np.append(at[1:], len(doc)) - 1]
        key, h, size, text = key[at], h[at], size[at], text[at]
        bucket = (key >> np.uint64(64 - bits)).astype(np.int64)
        cut = spans(bucket)
        for i in range(0, len(cut), 64):
            some = cut[i : i + 64]
            yield pd.DataFrame({"part": np.int64(part), "bucket": bucket[[a for a, _ in some]]} | {n: [x[a:z].tobytes() for a, z in some] for n, x in (("keys", key), ("hashes", h), ("least", least), ("most", most), ("size", size), ("bytes", text))})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, kept, count = None, [], 0
        for frame in frames:
            docs_ = frame["doc"].to_numpy(np.int64)
            for a, z in spans(frame["part"].to_numpy()):
                p = int(frame["part"].iat[a])
                if p != part:
                    if kept:
                        yield from blocks(part, kept)
                    part, kept, count, leads = p, [], 0, _leads_of(folder, p, bits)
                if not len(leads[0]):
                    continue
                for first, _, data, offsets in runs_of_texts(frame["t"].iloc[a:z].tolist(), _BUFFER):
                    start, n, key, h, text = _lead_runs(data, offsets, leads, bits)
                    # a very long text is sent piece by piece
                    for i in range(0, len(start), 50_000):
                        n_ = n[i : i + 50_000]
                        place = start[i : i + 50_000, None] + np.arange(REACH)
                        inside = np.arange(REACH) < (n_ + LENGTH - 1)[:, None]
                        bytes_ = np.where(inside, data[np.minimum(place, len(data) - 1)], 0).astype(np.uint8)
                        kept.append((key[i : i + 50_000], h[i : i + 50_000], docs_[a + first + text[i : i + 50_000]], n_.astype(np.uint8), bytes_))
                        count += len(n_)
                        if count > 100_000:
                            yield from blocks(part, kept)
                            kept, count = [], 0
        if kept:
            yield from blocks(part, kept)

    return docs.select("part", "doc", "t").mapInPandas(run, "part long, bucket long, keys binary, hashes binary, least binary, most binary, size binary, bytes binary")


def _least_of_windows(text: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each 50-byte row, the least number in low of all rows with the same bytes."""
    whole = np.ascontiguousarray(text[:, :48]).view(np.uint64)
    h = text[:, 48].astype(np.uint64) * np.uint64(256) + text[:, 49]
    for i in range(6):
        h = (h ^ (h >> np.uint64(29))) * _ODD[i] + whole[:, i] * _ODD[i + 1]
    h = mixed(h)
    order = np.lexsort((low, h))
    same = h[order[1:]] == h[order[:-1]]
    for i in range(0, len(same), 100_000):
        at = i + np.flatnonzero(same[i : i + 100_000])
        if (text[order[at]] != text[order[at + 1]]).any():  # different bytes of one hash: in the order of the bytes
            _, inverse = np.unique(np.ascontiguousarray(text).view(np.dtype((np.void, LENGTH))).ravel(), return_inverse=True)
            least = np.full(inverse.max() + 1, LAST)
            np.minimum.at(least, inverse, low)
            return least[inverse]
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    out = np.empty(len(h), np.int64)
    out[order] = np.repeat(low[order[first]], np.diff(np.append(first, len(h))))
    return out


def _compared(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One bucket: for each part's runs with a window that a smaller doc_id has, the least doc_id of each window."""
    get = lambda c, kind: np.frombuffer(b"".join(rows[c]), kind)
    keys, hashes, least, most, size = get("keys", np.uint64), get("hashes", np.uint64), get("least", np.int64), get("most", np.int64), get("size", np.uint8).astype(np.int64)
    text = get("bytes", np.uint8).reshape(-1, REACH)
    part = np.repeat(rows["part"].to_numpy(np.int64), [len(x) // 8 for x in rows["keys"]])
    n = len(keys)
    ends = np.cumsum(size)
    before = ends - size
    # a run that stands alone at its suffix needs no comparison
    _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
    meets = count[inverse] > 1
    lows = np.repeat(least, size)
    picked = np.flatnonzero(meets)
    row, column = np.repeat(picked, size[picked]), _ragged(np.zeros(len(picked), np.int64), size[picked])
    if len(row):
        windows = np.lib.stride_tricks.sliding_window_view(text, LENGTH, axis=1)[row, column]
        lows[_ragged(before[picked], size[picked])] = _least_of_windows(windows, lows[_ragged(before[picked], size[picked])])
    told = np.add.reduceat((lows < np.repeat(most, size)).astype(np.int64), before) > 0 if n else np.zeros(0, bool)
    at = np.flatnonzero(told)
    at = at[np.argsort(part[at], kind="stable")]
    out = []
    for a, z in spans(part[at]):
        own = at[a:z]
        values = lows[_ragged(before[own], size[own])]
        owner = np.repeat(np.arange(len(own)), size[own])
        change = np.flatnonzero(np.concatenate([[True], (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])]))
        lengths = np.diff(np.append(change, len(values))).astype(np.uint8)
        out.append({"part": int(part[own[0]]), "keys": keys[own].tobytes(), "hashes": hashes[own].tobytes(), "size": size[own].astype(np.uint8).tobytes(), "lengths": lengths.tobytes(), "lows": values[change].tobytes()})
    return pd.DataFrame(out, columns=["part", "keys", "hashes", "size", "lengths", "lows"])


class _Answers:
    """What one part got back: its runs, and the least doc_id of each of their windows."""

    def __init__(self, folder: str, part: int) -> None:
        columns = part_rows(folder, part, ["keys", "hashes", "size", "lengths", "lows"])
        keys, hashes, size, lengths, lows = (np.frombuffer(b"".join(c), k) for c, k in zip(columns, (np.uint64, np.uint64, np.uint8, np.uint8, np.int64), strict=True))
        size = size.astype(np.int64)
        self.lows = np.repeat(lows, lengths)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes, self.keys = hashes[self.order], keys[self.order]
        self.before, self.size = (np.cumsum(size) - size)[self.order], size[self.order]

    def removed(self, data: np.ndarray, offsets: np.ndarray, docs: np.ndarray, leads: tuple[np.ndarray, np.ndarray], bits: int) -> np.ndarray:
        """Where the windows start that a smaller doc_id has, each once."""
        if not len(self.keys):
            return np.zeros(0, np.int64)
        a, n, key, h, text = _lead_runs(data, offsets, leads, bits)
        at = places(self.hashes, h)
        ok = (at >= 0) & (self.keys[at] == key) & (self.size[at] == n)
        a, n, at, doc = a[ok], n[ok], at[ok], docs[text[ok]]
        return _ragged(a, n)[self.lows[_ragged(self.before[at], n)] < np.repeat(doc, n)]


def removed(docs: DataFrame, leads: str, answers: str, bits: int, with_bytes: bool = False) -> DataFrame:
    """doc, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left) of docs(part, doc, t)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = None
        for frame in frames:
            docs_ = frame["doc"].to_numpy(np.int64)
            for a, z in spans(frame["part"].to_numpy()):
                if (p := int(frame["part"].iat[a])) != part:
                    part, own, found = p, _leads_of(leads, p, bits), _Answers(answers, p)
                for first, end, data, offsets in runs_of_texts(frame["t"].iloc[a:z].tolist(), _BUFFER):
                    doc, sizes = docs_[a + first : a + end], np.diff(offsets) - 1
                    at = found.removed(data, offsets, doc, own, bits)
                    edge = np.zeros(len(data) + 1, np.int32)
                    edge[at] += 1
                    edge[at + LENGTH] -= 1
                    covered = np.cumsum(edge[:-1]) > 0
                    # the byte between texts is never covered, so spans end there
                    begins = covered & ~np.concatenate([[False], covered[:-1]])
                    gone, spans_ = np.add.reduceat(covered, offsets[:-1], dtype=np.int64), np.add.reduceat(begins, offsets[:-1], dtype=np.int64)
                    kept = [data[o : o + n].tobytes() if not g else data[o : o + n][~covered[o : o + n]].tobytes() for o, n, g in zip(offsets[:-1].tolist(), sizes.tolist(), gone.tolist(), strict=True)]
                    out = {"doc": doc, "n_bytes": sizes, "n_removed": gone, "n_spans": spans_, "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]}
                    yield pd.DataFrame(out | ({"kept": kept} if with_bytes else {}))

    return docs.select("part", "doc", "t").mapInPandas(run, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes)


def deduplicate(docs: DataFrame, s: Settings = Settings(), key: str = "doc_id", text: str = "text", with_bytes: bool = True) -> DataFrame:
    """removed() of all docs, indexed in batches of equal doc_id ranges; doc is null where the key is."""
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    d = parts_of(docs.select(key, text)).select(F.col("__part").alias("part"), F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("doc"), F.col(text).alias("t"))
    bits = bucket_bits(text_bytes(d, "t"), s.bucket)
    cuts = [c for c in d.agg(F.percentile_approx("doc", [i / s.batches for i in range(1, s.batches)], 1000).alias("c")).first()["c"] or []] if s.batches > 1 else []
    index, leads, low = SuffixIndex(spark, bits), None, None
    for high in [*sorted(set(cuts)), None]:
        part = d
        if low is not None:
            part = part.where(F.col("doc") > low)
        if high is not None:
            part = part.where(F.col("doc") <= high)
        got = index.add(part)
        leads = got if leads is None else leads.unionByName(got)
        low = high
    delivered(leads.groupBy("bucket").applyInPandas(_leads(s.common), "part long, bucket long, keys binary, many binary"), f"{folder}/leads")
    compared = lead_runs(d, f"{folder}/leads", bits).groupBy("bucket").applyInPandas(_compared, "part long, keys binary, hashes binary, size binary, lengths binary, lows binary")
    delivered(compared, f"{folder}/answers")
    out = removed(d, f"{folder}/leads", f"{folder}/answers", bits, with_bytes)
    return out.withColumn("doc", F.when(F.col("doc") != LAST, F.col("doc")))


def op9_suffix_index(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicate(docs, with_bytes=False).select(F.col("doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")

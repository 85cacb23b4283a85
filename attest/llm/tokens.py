"""Token ids of whole texts in binary files: patched frame-of-reference blocks.

A file holds the ids of consecutive documents. Ids are cut into blocks of 4096; each block stores
its minimum and the differences from it, packed at the width that a set percentile of them needs;
larger ones (the exceptions) are listed with their places. An index at the end has the byte where
each block starts, so that any id can be reached, and the documents' ids and lengths.

File: b"PFR1", blocks, index, trailer. Block: header of six 32-bit integers (ids, minimum, width,
exceptions, words, 0), packed 64-bit words, places (32 bits) and values (32 bits) of exceptions.
Index: block starts (64 bits), doc ids (64 bits; 0 for none), lengths (64 bits), a bit for each document
without an id. Trailer: counts of blocks and
documents and the index's start (64 bits each). All are little-endian.

Defined cases: null and empty texts hold the end id alone; very long texts span blocks; rows with
equal doc_id stand next to each other, ordered by text, those without one first; an empty table gives no files and no rows;
other columns are not written.
"""

from __future__ import annotations

import array
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attest.llm.shared import mapped, open_store, shared_folder, written

BLOCK = 4096
PERCENTILE = 95
MAGIC = b"PFR1"
END_ID = 1
#: Words whose ids a worker remembers; beyond, it starts anew.
REMEMBERED = 1_200_000


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Packs 64 numbers of some bits into that many 64-bit words, group by group."""
    groups = -(-len(values) // 64)
    v = np.zeros((groups, 64), np.uint64)
    v.reshape(-1)[: len(values)] = values
    out = np.zeros((width, groups), np.uint64)
    lanes = np.ascontiguousarray(v.T)
    for i in range(64 if width else 0):
        at, shift = divmod(i * width, 64)
        out[at] |= lanes[i] << np.uint64(shift)
        if shift + width > 64:
            out[at + 1] |= lanes[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).reshape(-1)


def unpack(words: np.ndarray, width: int, count: int) -> np.ndarray:
    groups = -(-count // 64)
    if not width:
        return np.zeros(count, np.uint64)
    w = np.ascontiguousarray(words.reshape(groups, width).T)
    out = np.zeros((64, groups), np.uint64)
    most = np.uint64((1 << width) - 1)
    for i in range(64):
        at, shift = divmod(i * width, 64)
        x = w[at] >> np.uint64(shift)
        if shift + width > 64:
            x = x | (w[at + 1] << np.uint64(64 - shift))
        out[i] = x & most
    return np.ascontiguousarray(out.T).reshape(-1)[:count]


def block_bytes(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    low = int(ids.min())
    d = (ids - np.uint32(low)).astype(np.uint64)
    width = int(np.percentile(d, percentile, method="higher")).bit_length()
    over = np.flatnonzero(d >> np.uint64(width))
    values = d[over].astype("<u4")
    d[over] = 0
    words = pack(d, width)
    head = struct.pack("<6I", len(ids), low, width, len(over), len(words), 0)
    return head + words.astype("<u8").tobytes() + over.astype("<u4").tobytes() + values.tobytes()


def block_ids(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """(ids, place after the block) of the block that starts at a byte."""
    count, low, width, extra, words, _ = struct.unpack_from("<6I", data, at)
    at += 24
    d = unpack(np.frombuffer(data, "<u8", words, at), width, count)
    at += 8 * words
    d[np.frombuffer(data, "<u4", extra, at)] = np.frombuffer(data, "<u4", extra, at + 4 * extra)
    return (d + np.uint64(low)).astype(np.uint32), at + 8 * extra


# The pre-tokenizer's pattern and the normalizers for which pieces between blanks
# are independent, so that each can be encoded once.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
#: Words for which Python and the tokenizer certainly agree on case, letters and special tokens.
_SIMPLE = re.compile(r"[!-&(-;=-{}~À-ÖØ-öø-ÿ]+")
_UNIT = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def _byte_letters() -> list[str]:
    """The letter for each byte: printable ones stand for themselves, others for 256 and up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class _Known(dict):
    """The ids of pieces between blanks, as bytes; a missing one is encoded when it is asked for."""

    def __init__(self, tokenizer, kind: str):
        super().__init__()
        self.tokenizer, self.model, self.kind = tokenizer, tokenizer.model, kind
        self.code = "H" if kind == "<u2" else "I"
        self.units: dict[str, bytes] = {}
        self.letters = _byte_letters()

    def __missing__(self, word: str) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        if _SIMPLE.fullmatch(word):
            got = b"".join([self.unit(u) for u in _UNIT.findall(word.lower())])
        else:
            got = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, self.kind).tobytes()
        self[word] = got
        return got

    def unit(self, unit: str) -> bytes:
        got = self.units.get(unit)
        if got is None:
            if len(self.units) > REMEMBERED:
                self.units.clear()
            spelled = unit if unit.isascii() else "".join([self.letters[b] for b in unit.encode()])
            got = self.units[unit] = array.array(self.code, [t.id for t in self.model.tokenize(spelled)]).tobytes()
        return got


class Encoder:
    """Encodes texts as the tokenizer does; each worker process keeps one for each file.

    Where the file's normalizers and pre-tokenizer are the known ones, no token crosses a blank or
    line feed, and the pieces between them are encoded once and remembered.
    """

    _held: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        cut = (told.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        apart = cut[0].get("pattern") == {"Regex": _SPLIT} and [x["type"] for x in (told.get("normalizer") or {}).get("normalizers", [])] == _NORMALIZERS
        self.known = _Known(self.tokenizer, self.kind) if apart else None

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def encode(self, texts: list[str | None], end_id: int) -> Iterator[np.ndarray]:
        end = np.array([end_id], self.kind).tobytes()
        for text in texts:
            if self.known is None:
                ids = self.tokenizer.encode(text or "", add_special_tokens=False).ids
                yield np.array([*ids, end_id], np.uint32)
                continue
            pieces = map(self.known.__getitem__, (text or "").replace("\n", " ").split(" "))
            yield np.frombuffer(b"".join([*pieces, end]), self.kind)


def write(docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Writes one file for each range of keys; returns (file, path, documents, ids), as a table.

    A file gets its name by a move, so a task that runs twice leaves one whole file.
    """
    d = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).repartitionByRange("k").sortWithinPartitions("k", "t")

    def run(part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        encoder, store, out, name = Encoder.of(tokenizer), None, None, f"tokens-{number:06d}.pfr"
        starts, keys, sizes, rest, total = [], [], [], np.zeros(0, np.uint32), 0
        for frame in part:
            if out is None:
                store, root = open_store(folder)
                store.create_dir(root, recursive=True)
                draft = f"{root}/.{name}-{TaskContext.get().taskAttemptId()}"
                out = store.open_output_stream(draft)
                out.write(MAGIC)
                at = len(MAGIC)
            got = list(encoder.encode(frame["t"].tolist(), end_id))
            keys += frame["k"].tolist()
            sizes += [len(g) for g in got]
            rest = np.concatenate([rest, *got]).astype(np.uint32)
            whole = len(rest) // BLOCK * BLOCK
            for i in range(0, whole, BLOCK):
                b = block_bytes(rest[i : i + BLOCK])
                starts.append(at)
                out.write(b)
                at += len(b)
            total, rest = total + whole, rest[whole:]
        if out is None:
            return
        if len(rest):
            b = block_bytes(rest)
            starts.append(at)
            out.write(b)
            at += len(b)
        for column in (starts, [k or 0 for k in keys], sizes):
            out.write(np.array(column, "<i8").tobytes())
        out.write(np.packbits([k is None for k in keys]).tobytes())
        out.write(struct.pack("<3q", len(starts), len(keys), at))
        out.close()
        store.move(draft, f"{root}/{name}")
        yield pd.DataFrame({"file": [number], "path": [f"{folder}/{name}"], "documents": [len(keys)], "ids": [total + len(rest)]})

    return written(mapped(d, run, "file int, path string, documents long, ids long"), f"{folder}-files")


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, read from the files.

    files: as write() returns them. start counts the ids of all documents before it.
    """
    before = F.coalesce(F.sum("ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spread = files.withColumn("before", before).repartition(max(1, files.count()), "file")

    def run(part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in part:
            for row in frame.itertuples():
                store, path = open_store(row.path)
                with store.open_input_file(path) as f:
                    yield _documents(f, int(row.before))

    return mapped(spread.select("path", "before"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _documents(f, before: int) -> pd.DataFrame:
    size = f.size()
    blocks, documents, index = struct.unpack("<3q", f.read_at(24, size - 24))
    column = np.frombuffer(f.read_at(8 * (blocks + 2 * documents), index), "<i8")
    nameless = np.unpackbits(np.frombuffer(f.read_at(-(-documents // 8), index + column.nbytes), np.uint8), count=documents).astype(bool)
    starts, keys, sizes = column[:blocks], column[blocks : blocks + documents], column[blocks + documents :]
    ends = np.append(starts[1:], index)
    crcs, rest, b = np.zeros(documents, np.int64), np.zeros(0, "<u4"), 0
    for i, n in enumerate(sizes):
        held, have = [rest], len(rest)
        while have < n:
            ids, _ = block_ids(f.read_at(int(ends[b] - starts[b]), int(starts[b])))
            held.append(ids)
            have += len(ids)
            b += 1
        joined = np.concatenate(held) if len(held) > 1 else rest
        crcs[i] = zlib.crc32(np.ascontiguousarray(joined[:n], "<u4").tobytes())
        rest = joined[n:]
    first = before + np.concatenate([[0], np.cumsum(sizes[:-1])]).astype(np.int64)[:documents]
    keys = np.where(nameless, None, keys) if nameless.any() else keys
    return pd.DataFrame({"doc_id": keys, "start": first, "n_tokens": sizes, "ids_crc32": crcs})


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read(write(docs, shared_folder(spark), public_tokenizers.path("word_bpe_49k.json")))

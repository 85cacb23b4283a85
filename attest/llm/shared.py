"""Helpers that several operators use: the shared folder, batching, and numpy views of texts."""

from __future__ import annotations

import ctypes
import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq  # in a task it would go over all archives of the path again
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Words are runs of anything but these.
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
WHITE_CLASS = r"[\x20\x09-\x0D]"
#: A word of the corpus is split off by bytes.split(), whose white space is the same six bytes.

_MASK = (1 << 64) - 1


#: Rows and bytes of an Arrow batch: texts may be long, and a task holds a batch several times over.
_BATCH_ROWS, _BATCH_BYTES = 1000, 16 << 20


def small_batches(spark: SparkSession) -> SparkSession:
    """Sets the session's Arrow batches to a thousand rows and 16 MB at most; smaller ones stay as they are."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= _BATCH_ROWS:
        spark.conf.set(name, str(_BATCH_ROWS))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark.conf.get(name).removesuffix("b")  # with another unit it is the session's own
    if size.isdigit() and int(size) > _BATCH_BYTES:
        spark.conf.set(name, str(_BATCH_BYTES))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which every executor and the driver see.

    Where the session has none, a temporary folder is made and set on a local master; elsewhere that
    is an error, since executors would not see it.
    """
    base = small_batches(spark).conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="attest-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    if "://" not in base and base.startswith("/"):
        base = "file://" + base
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a small or middling table by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, path: str) -> DataFrame:
    """The table once it is written at path: later readers don't compute it again."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a file that make a part: texts that are counted together and share what comes back.
PART_ROWS = 8192


def parts_of(docs: DataFrame, rows: int = PART_ROWS) -> DataFrame:
    """docs with __part, a number of the file and the range of so many of its rows that a row is read from.

    It does not change with the split size, so jobs that run on more or fewer cores agree on it. A
    table whose rows don't each come from one file's row (after a join or an aggregate, or of
    another source) is written in the shared folder first, once.
    """
    try:
        return _parted(docs, rows)
    except AnalysisException:
        return _parted(written(docs, f"{shared_folder(docs.sparkSession)}/docs"), rows)


def _parted(docs: DataFrame, rows: int) -> DataFrame:
    source = docs.metadataColumn("_metadata")
    return docs.select("*", F.xxhash64(source["file_path"], F.floor(source["row_index"] / rows)).alias("__part"))


def text_bytes(docs: DataFrame, text: str) -> int:
    """The bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0


def bucket_bits(size: int, each: int, least: int = 8) -> int:
    """So many bits of a hash that a bucket stands for about each of size bytes."""
    return min(32, max(least, math.ceil(math.log2(max(1, size / each)))))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_PLACES = 64
#: One random 64-bit number for each place in a word and byte there.
_TABLE = mixed(np.arange(_PLACES * 256, dtype=np.uint64) + np.uint64(0x51ED27))
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[ord(c) for c in WHITE]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def utf8(text: str | None) -> bytes:
    """The text's bytes; null is empty, and half surrogates become question marks."""
    return b"" if text is None else text.encode("utf-8", "replace")


def word_hashes(data: np.ndarray, solid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(start, 64-bit hash) of each word in a buffer of bytes, lower-cased A to Z; solid: the bytes of words."""
    solid = ~_IS_WHITE[data] if solid is None else solid
    if not solid.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    edge = np.diff(solid.view(np.int8), prepend=np.int8(0))
    starts = np.flatnonzero(edge == 1)
    at = np.flatnonzero(solid)
    order = np.cumsum(edge[at] == 1) - 1
    place = at - starts[order]
    key = _LOWER[data[at]].astype(np.int64)
    value = _TABLE[(place % _PLACES) * 256 + key]
    far = place >= _PLACES
    if far.any():
        value[far] = mixed((place[far].astype(np.uint64) << np.uint64(8)) + key[far].astype(np.uint64))
    first = np.flatnonzero(edge[at] == 1)
    return starts, mixed(np.add.reduceat(value, first))


def runs_of_texts(texts: Sequence[str | None], limit: int = 1_000_000, most: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a batch of texts into runs of some limit bytes and most texts: (first, end, buffer, offsets).

    A longer text is a run of its own. Each text in the buffer is followed by a line feed, so
    that no word goes over its end; offsets has one entry more than there are texts.
    """
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        b = utf8(text)
        if held and (size + len(b) > limit or len(held) == most):
            yield _run(first, held)
            first, held, size = i, [], 0
        held.append(b)
        size += len(b)
    if held:
        yield _run(first, held)


def _run(first: int, held: list[bytes]) -> tuple[int, int, np.ndarray, np.ndarray]:
    offsets = np.zeros(len(held) + 1, np.int64)
    np.cumsum([len(b) + 1 for b in held], out=offsets[1:])
    return first, first + len(held), np.frombuffer(b"\n".join(held) + b"\n", np.uint8), offsets


def words_of_texts(texts: Sequence[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(index, hashes of its words in order) of each text."""
    for first, end, data, offsets in runs_of_texts(texts):
        starts, hashes = word_hashes(data)
        cuts = np.searchsorted(starts, offsets)
        for i in range(first, end):
            yield i, hashes[cuts[i - first] : cuts[i - first + 1]]


def returned() -> None:
    """Gives memory that a task has freed back to the system: Spark reuses Python workers for other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def _series(column: pa.Array) -> pd.Series:
    """A column without loss: whole numbers and flags that have nulls, and nested values, as Python objects."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_binary(kind):
        return pd.Series(column.to_numpy(zero_copy_only=False), dtype=object)
    if column.null_count == 0 and (pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_boolean(kind)):
        return pd.Series(column.to_numpy(zero_copy_only=False))
    return pd.Series(column.to_pylist(), dtype=object)


def mapped(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """df.mapInPandas(run, schema), but whole numbers beside nulls stay whole.

    pandas would make doubles of them, which can't tell ids above 2**53 apart. Nulls are None.
    """
    to = to_arrow_schema(StructType.fromDDL(schema))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = (pd.DataFrame({n: _series(c) for n, c in zip(b.schema.names, b.columns, strict=True)}) for b in batches)
        for frame in run(frames):
            columns = [frame[f.name] for f in to]
            yield pa.RecordBatch.from_arrays([pa.array(c.tolist() if c.dtype == object else c.to_numpy(), f.type) for c, f in zip(columns, to, strict=True)], schema=to)
        returned()

    return df.mapInArrow(convert, schema)


def chunked(frames: Iterator[pd.DataFrame], text: str, most: int, rows: int = 20_000) -> Iterator[pd.DataFrame]:
    """Joins the batches of a task until they have some characters or rows: fewer, larger batches."""
    held: list[pd.DataFrame] = []
    size = count = 0
    for frame in frames:
        n = int(frame[text].str.len().sum())
        if held and (size + n > most or count + len(frame) > rows):
            yield pd.concat(held, ignore_index=True)
            held, size, count = [], 0, 0
        held.append(frame)
        size += n
        count += len(frame)
    if held:
        yield pd.concat(held, ignore_index=True)


def changed(sorted_: np.ndarray) -> np.ndarray:
    """Whether a number differs from that before it; the first does."""
    out = np.ones(len(sorted_), bool)
    np.not_equal(sorted_[1:], sorted_[:-1], out=out[1:])
    return out


def firsts(sorted_: np.ndarray) -> np.ndarray:
    """Where equal neighbours begin."""
    return np.flatnonzero(changed(sorted_))


def near_order(x: np.ndarray) -> np.ndarray:
    """The order of unsigned 64-bit numbers but for their last bits: sorting numbers takes a tenth of np.argsort()'s time.

    The places stand in the last bits of what is sorted.
    """
    bits = np.uint64(len(x).bit_length())
    free = np.uint64(64 - int(x.max()).bit_length()) if len(x) else np.uint64(0)
    held = (x << free) >> bits << bits if free < 64 else np.zeros(len(x), np.uint64)
    held |= np.arange(len(x), dtype=np.uint64)
    held.sort()
    held &= (np.uint64(1) << bits) - np.uint64(1)
    return held.view(np.int64)


def grouped(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct number of x, in their order; which of those each of x is), for unsigned 64-bit numbers.

    As np.unique(), but the last of equal ones is taken, and numbers are put in order by near_order().
    """
    order = near_order(x)
    near = x[order]
    if len(wrong := np.flatnonzero(near[1:] < near[:-1])):  # few runs differ in the last bits alone
        first = near >> np.uint64(max(0, len(x).bit_length() + int(x.max()).bit_length() - 64))
        runs = np.unique(first[wrong])
        start = np.searchsorted(first, runs)
        some = ranges(start, np.searchsorted(first, runs, "right") - start)
        order[some] = order[some[np.argsort(near[some], kind="stable")]]
        near = x[order]
    new, inverse = changed(near), np.empty(len(x), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[np.append(np.flatnonzero(new)[1:], len(x)) - 1] if len(x) else order, inverse


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places from each start on, so many of each."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def spans(sorted_: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the runs of equal neighbours."""
    at = firsts(sorted_)
    return list(zip(at, np.append(at[1:], len(sorted_))[: len(at)], strict=True))


def packed(sorted_: np.ndarray) -> bytes:
    """Sorted unsigned numbers as the byte planes of their steps, which compress well."""
    steps = np.diff(sorted_, prepend=sorted_.dtype.type(0))
    return steps.view(np.uint8).reshape(-1, sorted_.itemsize).T.tobytes()


def unpacked(b: bytes, kind: type = np.uint32) -> np.ndarray:
    size = np.dtype(kind).itemsize
    steps = np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel()
    return np.cumsum(steps, dtype=kind)


def planes(x: np.ndarray) -> bytes:
    """Numbers as their byte planes; the planes of high bytes are mostly zero."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def from_planes(b: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def hashed_blocks(part: int, hashes: np.ndarray, bits: int, **columns: np.ndarray) -> pd.DataFrame:
    """(part, bucket, keys, ...): sorted distinct 64-bit hashes cut by their first bits; keys has the next 32.

    Each further column becomes the bytes of its values for those hashes.
    """
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    keys = ((hashes << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
    cut = spans(bucket)
    return pd.DataFrame({"part": np.int64(part), "bucket": bucket[[a for a, _ in cut]], "keys": [packed(keys[a:z]) for a, z in cut]} | {c: [x[a:z].tobytes() for a, z in cut] for c, x in columns.items()})


def block_hashes(bucket: np.ndarray, keys: Sequence[bytes]) -> np.ndarray:
    """The first bits and 32 of the hashes of blocks, as one array."""
    return np.concatenate([np.zeros(0, np.uint64), *[(np.uint64(b) << np.uint64(32)) | unpacked(k).astype(np.uint64) for b, k in zip(bucket, keys, strict=True)]])


def places(sorted_: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted number in a sorted array, or -1."""
    if not len(sorted_):
        return np.full(len(wanted), -1)
    if len(wanted) > 1000:  # going through the array in order is several times as fast
        order = near_order(wanted.view(np.uint64)) if wanted.dtype.itemsize == 8 else np.argsort(wanted)
        at = np.empty(len(wanted), np.int64)
        at[order] = np.searchsorted(sorted_, wanted[order])
    else:
        at = np.searchsorted(sorted_, wanted)
    at[at == len(sorted_)] = 0
    at[sorted_[at] != wanted] = -1
    return at


def delivered(rows: DataFrame, path: str) -> None:
    """Writes rows with a column part so that each part can read its own."""
    rows.repartition("part").sortWithinPartitions("part").write.option("compression", "zstd").partitionBy("part").parquet(path)


def part_rows(folder: str, part: int, columns: Sequence[str]) -> list[list]:
    """The columns of a table that was delivered, for one part; empty where it has no rows.

    Numbers come as one array, binary values as a list.
    """
    store, root = open_store(f"{folder}/part={part}")
    files = [i.path for i in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if i.path.endswith(".parquet")]
    tables = [pq.read_table(f, filesystem=store, columns=list(columns), partitioning=None, use_threads=False) for f in sorted(files)]
    out = []
    for c in columns:
        chunks = [t.column(c) for t in tables]
        if chunks and pa.types.is_binary(chunks[0].type):
            out.append([x for chunk in chunks for x in chunk.to_pylist()])
        else:
            out.append(np.concatenate([x.to_numpy() for x in chunks]) if chunks else np.zeros(0, np.int64))
    return out


def part_lists(folder: str, part: int, key: str, values: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, values of all their lists, where each list ends after a first 0) of a delivered part."""
    store, root = open_store(f"{folder}/part={part}")
    keys, flat, ends, total = [np.zeros(0, np.int64)], [np.zeros(0, np.int16)], [np.zeros(1, np.int64)], 0
    for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if info.path.endswith(".parquet"):
            for batch in pq.ParquetFile(store.open_input_file(info.path)).iter_batches(50_000, columns=[key, values], use_threads=False):
                lists = batch.column(values)
                keys.append(batch.column(key).to_numpy())
                flat.append(lists.flatten().to_numpy(zero_copy_only=False))
                ends.append(total + np.cumsum(lists.value_lengths().to_numpy()))
                total = int(ends[-1][-1])
    pa.default_memory_pool().release_unused()
    return np.concatenate(keys), np.concatenate(flat), np.concatenate(ends)


def open_store(uri: str):
    """(file system, path) of a shared folder's address, by pyarrow."""
    return fs.FileSystem.from_uri(uri if re.match(r"\w+:", uri) else f"file://{uri}")

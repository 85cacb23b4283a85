"""WARC archives: writing, and the normaliser of archives that are one gzip stream.

write_archives() makes one gzip stream of all records of a partition, as simple crawlers do. The
normaliser inflates such a stream once, in pieces, rewrites every record as a gzip member of its
own and writes a sidecar index (offset, length, type, page) from which single records are read.

Of records with equal payloads of some length, that with the largest page_id is the response and
the others are revisits of it; shorter payloads are always responses.

Defined cases: a null page is an empty payload; rows with the same page_id and payload are each
written, and both are responses if that page_id is the largest; pages without a page_id are written, and
revisit a page of their payload that has one; very long payloads are streamed
through the normaliser in pieces, though each is one row in memory; an empty table gives no files
and no rows; other columns are not written.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.llm.shared import mapped, open_store, shared_folder, utf8, written

LEAST = 1000
LEVEL = 1
_PIECE = 1 << 20


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response or, if it refers to a page, a revisit whose block has the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = "".join(c if c.isprintable() and c != " " else "%20" for c in url or "urn:none")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{"none" if page_id is None else page_id}>",
        f"WARC-Target-URI: {uri}",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def header_fields(head: bytes) -> dict[str, str]:
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


def _plan(pages: DataFrame, key: str, html: str, url: str, least: int) -> DataFrame:
    """page_id, url, payload, digest and refers_to; the digests' largest pages come from a grouping.

    Digests meet as (page_id, digest) pairs of large pages alone; the pages themselves are joined by
    page_id and digest with those pairs that are revisits, so a payload that a third of all pages
    share, or an empty one, stays spread.
    """
    p = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    large = p.where(F.octet_length("html") >= least).select("page_id", "digest").distinct()
    same = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = large.join(same.where("refers_to is not null"), "digest").where("not page_id <=> refers_to")
    again = again.select(F.col("page_id").alias("of"), F.col("digest").alias("d"), "refers_to")
    return p.join(again, F.col("page_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("d")), "left").drop("of", "d")


def _task_file(folder: str, name: str):
    """(store, draft path, final path): the final name is given by a move, when all is written."""
    from pyspark import TaskContext

    store, root = open_store(folder)
    store.create_dir(root, recursive=True)
    return store, f"{root}/.{name}-{TaskContext.get().taskAttemptId()}", f"{root}/{name}"


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", html: str = "html", url: str = "url", least: int = LEAST) -> DataFrame:
    """One archive for each partition, each one gzip stream; returns a table of their paths."""

    def run(part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        name, out = f"pages-{TaskContext.get().partitionId():06d}.warc.gz", None
        for frame in part:
            if out is None:
                store, draft, final = _task_file(folder, name)
                out, gz = store.open_output_stream(draft), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            for row in frame.itertuples():
                out.write(gz.compress(record_bytes(row.page_id, row.url, utf8(row.html), row.digest, row.refers_to)))
        if out is not None:
            out.write(gz.flush())
            out.close()
            store.move(draft, final)
            yield pd.DataFrame({"path": [f"{folder}/{name}"]})

    return written(mapped(_plan(pages, key, html, url, least), run, "path string"), f"{folder}-archives")


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated WARC stream that comes in pieces."""
    held = bytearray()
    for piece in pieces:
        held += piece
        at = 0
        while (end := held.find(b"\r\n\r\n", at)) >= 0:
            stop = end + 4 + int(header_fields(bytes(held[at:end]))["content-length"]) + 4
            if stop > len(held):
                break
            yield bytes(held[at:stop])
            at = stop
        del held[:at]
    if held:
        raise ValueError(f"{len(held)} bytes after the last whole record")


def inflated(stream) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, in pieces of bounded size."""
    z = zlib.decompressobj(31)
    while data := stream.read(_PIECE):
        while data:
            yield z.decompress(data, _PIECE)
            data = z.unconsumed_tail
            if z.eof:
                data, z = z.unused_data, zlib.decompressobj(31)
    yield z.flush()


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrites each archive with a gzip member for each record, beside an index of the members."""
    spread = archives.repartition(max(1, archives.count()), "path")

    def run(part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in part:
            for source in frame["path"]:
                name = source.rsplit("/", 1)[1]
                store, draft, final = _task_file(folder, name)
                from_store, path = open_store(source)
                at = 0
                with from_store.open_input_stream(path, compression=None) as f, store.open_output_stream(draft, compression=None) as out, store.open_output_stream(f"{draft}.index") as index:
                    for record in records(inflated(f)):
                        member = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        data = member.compress(record) + member.flush()
                        fields = header_fields(record[: record.index(b"\r\n\r\n")])
                        out.write(data)
                        index.write(json.dumps({"offset": at, "length": len(data), "type": fields["warc-type"], "id": fields["warc-record-id"]}).encode() + b"\n")
                        at += len(data)
                store.move(f"{draft}.index", f"{final}.index")
                store.move(draft, final)
                yield pd.DataFrame({"path": [f"{folder}/{name}"]})

    return written(spread.mapInPandas(run, "path string"), f"{folder}-normalised")


def read_records(archives: DataFrame) -> DataFrame:
    """Every record, read by its index entry: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's digest is computed from its payload and must equal the header's.
    """
    spread = archives.repartition(max(1, archives.count()), "path")

    def run(part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in part:
            for source in frame["path"]:
                store, path = open_store(source)
                with store.open_input_stream(f"{path}.index", compression=None) as f:
                    entries = [json.loads(x) for x in f.read().splitlines()]
                with store.open_input_file(path) as f:
                    for i in range(0, len(entries), 1000):
                        got = [_entry(f.read_at(e["length"], e["offset"])) for e in entries[i : i + 1000]]
                        yield pd.DataFrame({k: pd.Series([g[k] for g in got], dtype=object) for k in got[0]})

    return mapped(spread, run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _entry(member: bytes) -> dict:
    record = zlib.decompress(member, 31)
    cut = record.index(b"\r\n\r\n")
    fields = header_fields(record[:cut])
    block = record[cut + 4 : -4]
    end = block.index(b"\r\n\r\n")
    length, digest = int(header_fields(block[:end])["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response" and hashlib.sha1(block[end + 4 :]).hexdigest() != digest:
        raise ValueError(f"{fields['warc-record-id']}: the payload has another digest")
    name = lambda x: x.strip("<>").rsplit(":", 1)[1]
    number = lambda x: None if name(x) == "none" else int(name(x))
    refers = fields.get("warc-refers-to")
    return {"page_id": number(fields["warc-record-id"]), "payload_bytes": length, "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": number(refers) if refers else None}


def op6_warc(spark, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    archives = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{folder}/raw")
    return read_records(normalise(archives, f"{folder}/members"))

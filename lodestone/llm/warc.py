"""WARC archives: write records, normalise monolithic gzip files to one member a record, index them, read them back.

``write`` deals pages to archive files; each is one gzip stream over all its records, as crawlers' tools often leave
them.  ``normalise`` inflates such a stream once, piece by piece, writes each record as a gzip member of its own and a
sidecar index (offset and length of each member).  ``read`` takes the members by that index.  A payload of at least
``min_bytes`` that several pages share is stored once, with the smallest page_id; the others are revisit records.

Archives are rows of a table in the shared folder (archive, raw, index), written by Spark's own committer, so that any
store works, a lost executor's half-written archive never shows, and no task holds more than one archive of about
``archive_bytes``; ``export`` writes them as .warc.gz and .idx files where a plain folder is wanted.

Defined results: null html is an empty payload; payloads under ``min_bytes`` are always responses; rows that repeat a
page_id with the same payload are responses or revisits of that page_id like any others; one without a page_id
keeps that null and is never referred to; an empty table gives no archive and no row.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, batch, cut, id_bucket, table

MIN_BYTES = 100
ARCHIVE_BYTES = 8 << 20
LEVEL = 3


def with_roles(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, payload binary, payload_bytes, payload_digest, record_type, refers_to, first_url.

    The first page of each digest is found by a grouped minimum over ids and digests (partial sums first, so a payload that
    a third of all pages share is one row a task).  The few hot digests are sent to the pages (fewer than HOT_SHARE rows).
    Of the others a filter of fixed size is sent: pages that it rules out are of one of a kind and stay where they are, only
    the payloads of those that may repeat are joined, by Spark's choice: by a shuffle that hot ones don't skew.
    """
    p = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    slim = p.filter(F.col("payload_bytes") >= min_bytes).select("page_id", "url", "payload_digest")
    first = slim.groupBy("payload_digest").agg(F.min_by("url", "page_id").alias("first_url"), F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    first = cut(first.filter("n > 1"))
    total = first.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT_SHARE > total
    named = lambda df, x: df.select(F.col("payload_digest").alias(f"key_{x}"), F.col("first_url").alias(f"url_{x}"), F.col("first_id").alias(f"id_{x}"))
    p = p.join(F.broadcast(named(first.filter(hot), "hot")), F.col("payload_digest") == F.col("key_hot"), "left")
    rest = first.filter(~hot)
    # pages of hot digests are settled, and so are those whose digest the filter doesn't know
    buckets = F.broadcast(rest.select(id_bucket("payload_digest").alias("_b")).distinct())  # 2**FILTER_BITS at most
    p = p.withColumn("_k", F.when(F.col("key_hot").isNull(), id_bucket("payload_digest")))
    cols = ["page_id", "url", "payload", "payload_bytes", "payload_digest"]
    settled = p.join(buckets, F.col("_k") == F.col("_b"), "left_anti").select(*cols, F.col("id_hot").alias("first_id"), F.col("url_hot").alias("first_url"))
    open_ = p.join(buckets, F.col("_k") == F.col("_b"), "left_semi").join(named(rest, "rest"), F.col("payload_digest") == F.col("key_rest"), "left")
    out = settled.unionByName(open_.select(*cols, F.col("id_rest").alias("first_id"), F.col("url_rest").alias("first_url")))
    again = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    return out.select(
        "page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first_id")).alias("refers_to"), F.when(again, F.col("first_url")).alias("first_url"),
    )


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, kind: str, refers: int | None, first_url: str | None) -> bytes:
    """One WARC/1.1 record with an HTTP response block."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload or b"" if kind == "response" else b"")
    clean = lambda u: "".join(c for c in u if c not in "\r\n")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}", "WARC-Date: 2024-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {clean(url)}"] if url else []), f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers)}"]
        head += [f"WARC-Refers-To-Target-URI: {clean(first_url)}"] if first_url else []
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """page_id, record_type, payload_bytes, payload_digest, refers_to of a record; a response's are taken from its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    h = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(h["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
    out = {"page_id": number(h["WARC-Record-ID"]), "record_type": h["WARC-Type"], "refers_to": None}
    if out["record_type"] == "response":
        out |= {"payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}
        if h["WARC-Payload-Digest"] != "sha256:" + out["payload_digest"]:
            raise ValueError(f"record {h['WARC-Record-ID']}: its payload has another digest than its header")
        return out
    return out | {"payload_bytes": int(h["X-Payload-Length"]), "payload_digest": h["WARC-Payload-Digest"].removeprefix("sha256:"), "refers_to": number(h["WARC-Refers-To"])}


def write(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL) -> DataFrame:
    """archive string, raw binary: monolithic gzip files of the rows of with_roles()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deflate, got, seen, made = None, [], 0, 0
        name = lambda: f"pages-{TaskContext.get().partitionId():06d}-{made:06d}.warc.gz"
        kinds = {"archive": pa.string(), "raw": pa.binary()}
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "first_url"))):
                r = record(*row)
                if deflate is None:
                    deflate, got, seen = zlib.compressobj(level, zlib.DEFLATED, 31), [], 0
                got.append(deflate.compress(r))
                seen += len(r)
                if seen >= archive_bytes:
                    yield batch(kinds, archive=[name()], raw=[b"".join(got) + deflate.flush()])
                    deflate, made = None, made + 1
        if deflate is not None:
            yield batch(kinds, archive=[name()], raw=[b"".join(got) + deflate.flush()])

    return pages.mapInArrow(run, "archive string, raw binary")


def inflated(raw: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """What a gzip file of one or many members holds, piece by piece; each byte of it is inflated once."""
    data, inflate = memoryview(raw), zlib.decompressobj(31)
    for at in range(0, len(data), step):
        piece = data[at : at + step]
        while len(piece):
            if inflate.eof:
                inflate = zlib.decompressobj(31)
            yield inflate.decompress(piece)
            piece = inflate.unused_data


def records(raw: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The records of a gzip file of one or many members, inflated once as a stream.

    Bytes are added at the end of one buffer and taken from its front; a header is looked for from where the last look ended.
    """
    buf, start, seen, need = bytearray(), 0, 0, None
    for piece in inflated(raw, step):
        buf += piece
        while True:
            if need is None:
                end = buf.find(b"\r\n\r\n", max(start, seen - 3))
                seen = len(buf)
                if end < 0:
                    break
                size = next(int(x[15:]) for x in bytes(buf[start:end]).split(b"\r\n") if x.lower().startswith(b"content-length:"))
                need = end + 4 + size + 4 - start
            if len(buf) - start < need:
                break
            yield bytes(buf[start : start + need])
            start, need = start + need, None
            seen = start
        if start > step:
            del buf[:start]
            start, seen = 0, seen - start
    if need is not None or start < len(buf):
        raise ValueError("the archive ends inside a record")


def normal(raw: bytes, level: int = LEVEL) -> tuple[bytes, list[tuple[int, int]]]:
    """The archive with a member for each record, and their offsets and lengths."""
    out, index = io.BytesIO(), []
    for r in records(raw):
        c = zlib.compressobj(level, zlib.DEFLATED, 31)
        member = c.compress(r) + c.flush()
        index.append((out.tell(), len(member)))
        out.write(member)
    return out.getvalue(), index


def normalise(archives: DataFrame, level: int = LEVEL) -> DataFrame:
    """archive, raw, index array<struct<offset, length>>: one gzip member a record, with the sidecar index."""
    entry = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column("archive"), b.column("raw")):
                members, index = normal(raw.as_py(), level)
                yield batch({"archive": pa.string(), "raw": pa.binary(), "index": entry}, archive=[name.as_py()], raw=[members], index=[[{"offset": o, "length": n} for o, n in index]])

    return archives.mapInArrow(run, "archive string, raw binary, index array<struct<offset:long,length:long>>")


def read(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record, by the sidecar index."""
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw, index in zip(b.column("raw"), b.column("index")):
                data = memoryview(raw.as_buffer())
                got = [parse(zlib.decompress(data[e["offset"] : e["offset"] + e["length"]], 31)) for e in index.as_py()]
                yield batch(kinds, **{k: [g[k] for g in got] for k in kinds})

    return archives.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def export(archives: DataFrame, uri: str) -> DataFrame:
    """Write normalised archives as <uri>/<archive> and <archive>.idx through pyarrow's file systems; a row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        for b in batches:
            for name, raw, index in zip(b.column("archive").to_pylist(), b.column("raw"), b.column("index").to_pylist()):
                for end, data in (("", raw.as_py()), (".idx", "".join(f"{e['offset']} {e['length']}\n" for e in index).encode())):
                    with store.open_output_stream(f"{root}/{name}{end}", compression=None) as f:
                        f.write(data)
                yield batch({"archive": pa.string(), "records": pa.int64()}, archive=[name], records=[len(index)])

    return archives.mapInArrow(run, "archive string, records long")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    one_stream = cut(write(with_roles(table(spark, sf_dir, "pages"))))
    return read(cut(normalise(one_stream)))

"""Deterministic sharded WARC archives of web pages.

Pages are cut into ranges of page_id, each range is sorted and written as files that roll at a compressed size. Every
record is a gzip member of its own; its headers, ids and digests are made anew from the page. Files are written under
temporary names and renamed when complete, and a manifest written last lists those that count, so that a lost
executor or a repeated task leaves nothing that is read.
"""

from __future__ import annotations

import base64
import collections
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, sha1: str, n: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page_id}:{sha1}:{n}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, n: int, refers_to: int | None, date: str, level: int) -> bytes:
    """One record as a gzip member. n tells rows apart that have the same page_id and payload."""
    block = b"" if refers_to is not None else payload
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, sha1, n)}",
        f"WARC-Date: {date}",
        "WARC-Target-URI: " + " ".join((url or "").split()),
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"WARC-Block-Digest: sha1:{digest(http + block)}",
        f"X-Payload-Length: {len(payload)}",
        *([f"X-Page-ID: {page_id}"] if page_id is not None else []),
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, sha1, 0)}", f"X-Refers-To-Page-ID: {refers_to}"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + len(block)}",
    ]
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + http + block + b"\r\n\r\n") + pack.flush()


def write_warc(pages: DataFrame, path: str, roll_bytes: int = 16 << 20, rows_per_shard: int = 1024, max_shards: int = 10_000, min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 4) -> str:
    """Write `pages` (page_id, url, html) to WARC files under path; returns path.

    A null html has an empty payload. Of rows with equal payloads of at least min_revisit_bytes bytes, the one with
    the smallest page_id is the response and the others are revisits of it; among rows with that same page_id the
    first by url is the response. Rows without page_id are responses always, and nothing refers to them. They come
    first. The bytes of the files depend on the rows alone, not on their order or partitions. Other columns of pages
    are ignored.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    hashed = rows.where("page_id is not null").select("page_id", F.length("payload").alias("size"), F.unhex(F.sha1("payload")).alias("sha1")).where(F.col("size") >= min_revisit_bytes)
    first = hashed.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha1", "first")
    # both sides can be large: a join that AQE may split, whatever the estimates say
    revisits = hashed.join(first.hint("merge"), "sha1").select("page_id", F.lit(None).cast("string").alias("url"), F.col("sha1").alias("payload"), "first").distinct()
    n_rows = pages.count()
    cuts = common.id_boundaries(rows, "page_id", int(min(max_shards, max(1, -(-n_rows // rows_per_shard)))))
    both = revisits.unionByName(rows.withColumn("first", F.lit(None).cast("long"))).withColumns({"shard": common.shard_column("page_id", cuts), "kind": F.col("first").isNull().cast("int")})
    filesys, root = common.filesystem(path)
    filesys.create_dir(root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesys, root = common.filesystem(path)
        out: dict | None = None
        known: dict[bytes, int] = {}  # the payload hashes of the current page_id and whom they refer to
        seen: collections.Counter = collections.Counter()  # its rows so far, by payload; of rows without page_id, all
        page, shard_now, number = None, None, 0

        def close() -> pa.RecordBatch:
            size = out["file"].tell()
            out["file"].close()
            common.commit(filesys, out["temp"], f"{root}/{out['name']}")
            return pa.RecordBatch.from_pydict({"shard": pa.array([out["shard"]], pa.int32()), "name": [out["name"]], "records": pa.array([out["n"]], pa.int64()), "bytes": pa.array([size], pa.int64()), "sha1": [out["sha1"].hexdigest()]})

        for batch in batches:
            for shard, kind, page_id, first, url, payload in zip(*(batch.column(i) for i in range(6)), strict=True):
                shard, kind, page_id, first, url, payload = shard.as_py(), kind.as_py(), page_id.as_py(), first.as_py(), url.as_py(), payload.as_py()
                if (shard, page_id) != page:
                    page, known, seen = (shard, page_id), {}, collections.Counter()
                if kind == 0:
                    known[payload] = first
                    continue
                if shard != shard_now:
                    if out:
                        yield close()
                    out, shard_now, number = None, shard, 0
                sha1 = digest(payload)
                key = sha1 if page_id is not None else ""
                n, seen[key] = seen[key], seen[key] + 1
                first = known.get(hashlib.sha1(payload).digest()) if page_id is not None else None
                refers = first if first is not None and (first != page_id or n) else None
                data = record(page_id, url, payload, sha1, n, refers, date, level)
                if out and out["n"] and out["file"].tell() + len(data) > roll_bytes:
                    yield close()
                    out = None
                if out is None:
                    name = f"pages-{shard:06d}-{number:05d}.warc.gz"
                    number += 1
                    temp = f"{root}/.{name}.{TaskContext.get().taskAttemptId()}.tmp"
                    out = {"shard": shard, "name": name, "temp": temp, "file": filesys.open_output_stream(temp, compression=None), "n": 0, "sha1": hashlib.sha1()}
                out["file"].write(data)
                out["sha1"].update(data)
                out["n"] += 1
        if out:
            yield close()

    dealt = both.repartitionByRange(len(cuts) + 1, "shard").sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "kind", F.col("url").asc_nulls_first(), "payload")
    dealt.select("shard", "kind", "page_id", "first", "url", "payload").mapInArrow(write, "shard int, name string, records long, bytes long, sha1 string").write.parquet(f"{path}/manifest")
    return path


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a .warc.gz stream, read a record at a time."""
    unpack, raw, data = zlib.decompressobj(31), b"", bytearray()
    while raw or (raw := stream.read(1 << 20)):
        data += unpack.decompress(raw)
        raw = unpack.unused_data if unpack.eof else b""
        if unpack.eof:
            head, body = bytes(data).split(b"\r\n\r\n", 1)
            headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
            yield headers, body[: int(headers["Content-Length"])]
            unpack, data = zlib.decompressobj(31), bytearray()


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of the manifest's files: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    A response's digest and length are taken from its payload and must agree with its headers. A revisit has no
    payload; its headers tell those of the page.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesys, root = common.filesystem(path)
        for files in batches:
            for name in files["name"]:
                rows: list[tuple] = []
                held = 0
                with filesys.open_input_stream(f"{root}/{name}", compression=None) as f:
                    for head, block in records(f):
                        payload = block.split(b"\r\n\r\n", 1)[1]
                        size, sha1 = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if head["WARC-Type"] == "response" and (len(payload), digest(payload)) != (size, sha1):
                            raise ValueError(f"{name}: {head['WARC-Record-ID']} is damaged")
                        page, refers = head.get("X-Page-ID"), head.get("X-Refers-To-Page-ID")
                        rows.append((page and int(page), head["WARC-Target-URI"], size, sha1, head["WARC-Type"], refers and int(refers), *([payload] if with_payload else [])))
                        held += len(payload) * with_payload
                        if held > 32 << 20 or len(rows) >= 20_000:
                            yield frame(rows)
                            rows, held = [], 0
                if rows:
                    yield frame(rows)

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    listed = spark.read.parquet(f"{path}/manifest").select("name")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return listed.repartition(max(1, min(listed.count(), 10_000)), "name").mapInPandas(read, schema)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, written to archives and read back; odd input as in write_warc()."""
    path = write_warc(common.load(spark, sf_dir, "pages"), common.scratch(spark, "warc"))
    return read_warc(spark, path, with_payload=False).drop("url")

"""Packing by power-of-two decomposition: pieces of binary length, bucketed by length, never across documents.

A document of n ids becomes n // max_len pieces of max_len and one piece for each bit of the rest, longest first.
Each piece is a sequence of its own, so there is no padding and no sequence holds two documents; a loader draws
batches from buckets of equal length. There is no shuffle: pieces are made where the text is read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens


def piece_lengths(n: int, max_len: int = 2048) -> list[int]:
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, max_len: int = 2048, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket and, if asked, ids.

    max_len must be a power of two. A null or empty text has the end id only and makes one piece of length 1. Null
    and repeated ids stay as they are: each row is a document. sequence_id is unique; it comes from the read
    partition and the place in it, so the same table read in the same splits gives the same numbers. bucket is
    log2(length). Other columns of docs are ignored.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    path = tokenizer_path or tokens.default_path()
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else "")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokens.tokenizer(path)
        for batch in batches:
            doc_ids, at = batch.column(0).to_pylist(), 0
            for ids, starts in tok.encoded(batch.column(1)):
                raw, rows, held = memoryview(ids.astype("<u4")).cast("B"), [], 0
                for doc_id, begin, n in zip(doc_ids[at : at + len(starts) - 1], starts.tolist(), np.diff(starts).tolist(), strict=False):
                    start = 0
                    for length in piece_lengths(n, max_len):
                        part = raw[4 * (begin + start) : 4 * (begin + start + length)]
                        rows.append((doc_id, start, length, zlib.crc32(part), n, *([part] if with_ids else [])))
                        start += length
                    held += n
                    if with_ids and held > 500_000 or len(rows) > 50_000:
                        yield _batch(rows, with_ids)
                        rows, held = [], 0
                at += len(starts) - 1
                if rows:
                    yield _batch(rows, with_ids)

    made = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pieces, schema)
    return made.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "bucket": F.log2("length").cast("int")})


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    arrays = [pa.array(c, pa.int64()) for c in columns[:5]]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    if with_ids:
        ends = np.concatenate([[0], np.cumsum(columns[2])]).astype("int32")
        arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(columns[5]), dtype="<u4").astype("int32"))))
        names.append("ids")
    return pa.RecordBatch.from_arrays(arrays, names)


def write_packed(pieces: DataFrame, path: str) -> None:
    """Write pieces with their ids in one folder for each length, as loaders want them."""
    pieces.write.partitionBy("bucket").parquet(path)


def op10_pack_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all whole documents with their buckets of equal length; odd input as in pack_documents()."""
    return pack_documents(common.load(spark, sf_dir, "documents"), with_ids=False)

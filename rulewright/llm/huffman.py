"""Token ids on disk: canonical length-limited Huffman codes from global counts.

Layout of a file (little-endian): MAGIC, blocks, index, footer.
A block: n_ids u4, n_checkpoints u4, n_bytes u4, checkpoints u4 each (bit offset of every `interval`-th id), payload.
The index: doc_id i8 each, n_tokens i8 each, null flag u1 each, in ascending order of doc_id. The footer: JSON and
its length u4. Blocks are decoded on their own, all checkpoints of a block in step, by one table look-up an id. The
code book (one length per id) lies beside the files, as does manifest/, which lists the files that count.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

MAGIC = b"RWHUFF1\n"


def code_lengths(counts: np.ndarray, limit: int = 18) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits for the symbols with a count, by package-merge; 0 for the others."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("limit is too small for so many symbols")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.float64)
    levels, row = [], leaves
    is_leaf = np.ones(len(leaves), dtype=bool)
    for _ in range(limit - 1):
        levels.append(is_leaf)
        even = len(row) // 2 * 2
        packages = row[0:even:2] + row[1:even:2]
        both = np.concatenate([leaves, packages])
        order = np.argsort(both, kind="stable")
        row, is_leaf = both[order], order < len(leaves)
    levels.append(is_leaf)
    take = 2 * len(leaves) - 2
    depth = np.zeros(len(leaves), dtype=np.int64)
    for is_leaf in reversed(levels):
        n_leaves = int(is_leaf[:take].sum())
        depth[:n_leaves] += 1
        take = 2 * (take - n_leaves)
    lengths[used] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    codes = np.zeros(len(lengths), dtype=np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code, last = 0, 0
    sizes = np.bincount(lengths[order], minlength=2) if len(order) else []
    at = 0
    for length, n in enumerate(sizes):
        code <<= length - last
        codes[order[at : at + n]] = code + np.arange(n, dtype=np.uint64)
        code, last, at = code + int(n), length, at + n
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every window of `width` bits: the id that it begins with and that id's length."""
    width = max(1, int(lengths.max(initial=0)))
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = (1 << (width - lengths[order].astype(np.int64)))
    symbols, bits = np.zeros(1 << width, dtype=np.uint32), np.ones(1 << width, dtype=np.int64)
    filled = int(spans.sum())
    symbols[:filled], bits[:filled] = np.repeat(order, spans), np.repeat(lengths[order].astype(np.int64), spans)
    return symbols, bits, width


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, interval: int) -> bytes:
    code, size = codes[ids], lengths[ids].astype(np.int64)
    at = np.cumsum(size) - size
    total = int(at[-1] + size[-1])
    word, room = at >> 6, 64 - (at & 63) - size
    packed = np.zeros(total // 64 + 2, dtype=np.uint64)
    high = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    packed[word[starts]] = np.add.reduceat(high, starts)
    over = room < 0
    packed[word[over] + 1] += code[over] << (64 + room[over]).astype(np.uint64)
    payload = packed.astype(">u8").tobytes()[: (total + 7) // 8]
    marks = at[::interval].astype("<u4")
    return struct.pack("<III", len(ids), len(marks), len(payload)) + marks.tobytes() + payload


def decode_block(n: int, marks: np.ndarray, payload: bytes, table: tuple[np.ndarray, np.ndarray, int], interval: int) -> np.ndarray:
    symbols, bits, width = table
    raw = np.frombuffer(payload + bytes(8), dtype=np.uint8).astype(np.uint32)
    windows = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    at, last, mask = marks.astype(np.int64), len(windows) - 1, (1 << width) - 1
    out = np.empty((min(interval, n), len(marks)), dtype=np.uint32)
    for j in range(len(out)):
        seen = (windows[np.minimum(at >> 3, last)].astype(np.int64) >> (32 - width - (at & 7))) & mask
        out[j] = symbols[seen]
        at += bits[seen]
    return out.T.reshape(-1)[:n]


def tokenised(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of kind 0: doc_id, n_tokens and ids (unsigned little-endian, 16 bits if the vocabulary allows) with the end id.

    Each task adds a row of kind 1, whose ids are how often it has met each id of the vocabulary (64-bit integers).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokens.tokenizer(path)
        total = np.zeros(vocabulary_size(path), dtype=np.int64)
        for batch in batches:
            at = 0
            for ids, starts in tok.encoded(batch.column(1)):
                n = len(starts) - 1
                total += np.bincount(ids, minlength=len(total))
                blobs = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((starts * ids.itemsize).astype("<i4")), pa.py_buffer(np.ascontiguousarray(ids))])
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, dtype=np.int32)), batch.column(0).slice(at, n), pa.array(np.diff(starts)), blobs], names)
                at += n
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([None], pa.int64()), pa.array([0], pa.int64()), pa.array([total.tobytes()], pa.binary())], names)

    names = ["kind", "doc_id", "n_tokens", "ids"]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "kind int, doc_id long, n_tokens long, ids binary")


def vocabulary_size(path: str) -> int:
    return max(tokens.tokenizer(path).tokenizer.get_vocab_size(), tokens.END_ID + 1)


def id_counts(made: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs, from the rows of kind 1."""

    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, dtype=np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_py(), dtype=np.int64)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])

    rows = made.where("kind = 1").select("ids").mapInArrow(used, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(vocabulary, dtype=np.int64)
    counts[rows["id"]] = rows["n"]
    return counts


def write_ids(docs: DataFrame, path: str, tokenizer_path: str | None = None, ids_per_shard: int = 8_000_000, block_ids: int = 1 << 16, interval: int = 128, limit: int = 18, max_shards: int = 10_000) -> str:
    """Tokenise docs and write their ids to `path`, ordered by doc_id, each shard a file; returns path.

    Null texts count as empty. A null doc_id sorts first; rows with the same doc_id are ordered by their ids, so the
    files are the same however docs is partitioned. Files are written under temporary names and renamed when
    complete; the manifest is written last.
    """
    tokenizer_path = tokenizer_path or tokens.default_path()
    vocabulary = vocabulary_size(tokenizer_path)
    made = common.saved(tokenised(docs, tokenizer_path), "ids", "kind")
    lengths = code_lengths(id_counts(made, vocabulary), limit)
    codes = canonical_codes(lengths)
    made = made.where("kind = 0")
    filesys, root = common.filesystem(path)
    filesys.create_dir(root)
    with filesys.open_output_stream(f"{root}/codebook.bin", compression=None) as f:
        f.write(json.dumps({"interval": interval, "vocabulary": vocabulary}).encode() + b"\n" + zlib.compress(lengths.tobytes()))
    total = made.agg(F.sum("n_tokens")).first()[0] or 0
    n_shards = int(min(max_shards, max(1, -(-total // ids_per_shard))))
    cuts = common.id_boundaries(made, "doc_id", n_shards)
    made = made.withColumn("shard", common.shard_column("doc_id", cuts))
    sums = {r["shard"]: r["n"] for r in made.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()}
    base, at = {}, 0
    for shard in sorted(sums):
        base[shard], at = at, at + sums[shard]
    width = 2 if vocabulary <= 1 << 16 else 4

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesys, root = common.filesystem(path)
        out: dict | None = None

        def flush(least: int) -> None:
            while out["held"] >= least and out["held"]:
                ids = np.concatenate(out["parts"])
                out["file"].write(encode_block(ids[:block_ids], codes, lengths, interval))
                out["parts"] = [ids[block_ids:]]
                out["held"] = len(ids[block_ids:])

        def close() -> pa.RecordBatch:
            flush(1)
            index = out["file"].tell()
            none = np.array([d is None for d in out["docs"]], dtype=np.uint8)
            out["file"].write(np.array([d or 0 for d in out["docs"]], dtype="<i8").tobytes() + np.array(out["sizes"], dtype="<i8").tobytes() + none.tobytes())
            foot = json.dumps({"docs": len(out["docs"]), "ids": int(sum(out["sizes"])), "start": int(base[out["shard"]]), "index": index}).encode()
            out["file"].write(foot + struct.pack("<I", len(foot)))
            size = out["file"].tell()
            out["file"].close()
            common.commit(filesys, out["temp"], out["final"])
            return pa.RecordBatch.from_pydict({"shard": pa.array([out["shard"]], pa.int32()), "name": [out["name"]], "docs": pa.array([len(out["docs"])], pa.int64()), "bytes": pa.array([size], pa.int64())})

        for batch in batches:
            for shard, doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if out and out["shard"] != shard:
                    yield close()
                    out = None
                if out is None:
                    name = f"ids-{shard:06d}.huff"
                    temp = f"{root}/.{name}.{TaskContext.get().taskAttemptId()}.tmp"
                    out = {"shard": shard, "name": name, "temp": temp, "final": f"{root}/{name}", "file": filesys.open_output_stream(temp, compression=None), "parts": [], "held": 0, "docs": [], "sizes": []}
                    out["file"].write(MAGIC)
                ids = np.frombuffer(ids.as_py(), dtype=f"<u{width}")
                out["docs"].append(doc_id)
                out["sizes"].append(len(ids))
                out["parts"].append(ids)
                out["held"] += len(ids)
                if out["held"] >= 4 * block_ids:
                    flush(block_ids)
        if out:
            yield close()

    n_tasks = max(len(sums), 1)
    files = made.select("shard", "doc_id", "ids").repartitionByRange(n_tasks, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")
    files.mapInArrow(write, "shard int, name string, docs long, bytes long").write.parquet(f"{path}/manifest")
    return path


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files of the manifest, decoded block by block."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesys, root = common.filesystem(path)
        with filesys.open_input_stream(f"{root}/codebook.bin", compression=None) as f:
            head, packed = f.read().split(b"\n", 1)
        interval = json.loads(head)["interval"]
        table = decode_table(np.frombuffer(zlib.decompress(packed), dtype=np.uint8))
        for files in batches:
            for name in files["name"]:
                with filesys.open_input_file(f"{root}/{name}") as f:
                    yield _read_file(f, table, interval)

    listed = spark.read.parquet(f"{path}/manifest").select("name")
    tasks = max(1, min(listed.count(), 10_000))
    return listed.repartition(tasks, "name").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _read_file(f, table: tuple, interval: int) -> pd.DataFrame:
    size = f.size()
    n_foot = struct.unpack("<I", f.read_at(4, size - 4))[0]
    foot = json.loads(f.read_at(n_foot, size - 4 - n_foot))
    raw = f.read_at(17 * foot["docs"], foot["index"])
    n = foot["docs"]
    docs, sizes, none = np.frombuffer(raw[: 8 * n], dtype="<i8"), np.frombuffer(raw[8 * n : 16 * n], dtype="<i8"), np.frombuffer(raw[16 * n :], dtype=np.uint8)
    crcs = np.zeros(n, dtype=np.int64)
    at, doc, left = len(MAGIC), 0, int(sizes[0]) if n else 0
    while at < foot["index"]:
        n_ids, n_marks, n_bytes = struct.unpack("<III", f.read_at(12, at))
        body = f.read_at(4 * n_marks + n_bytes, at + 12)
        ids = decode_block(n_ids, np.frombuffer(body[: 4 * n_marks], dtype="<u4"), body[4 * n_marks :], table, interval).astype("<u4").tobytes()
        at, used = at + 12 + len(body), 0
        while used < n_ids:
            take = min(left, n_ids - used)
            crcs[doc] = zlib.crc32(ids[4 * used : 4 * (used + take)], int(crcs[doc]))
            used, left = used + take, left - take
            if not left and doc + 1 < n:
                doc += 1
                left = int(sizes[doc])
    starts = foot["start"] + np.cumsum(sizes) - sizes
    return pd.DataFrame({"doc_id": pd.array(docs, dtype="Int64").copy(), "start": starts, "n_tokens": sizes, "ids_crc32": crcs}).assign(doc_id=lambda x: x["doc_id"].mask(none.astype(bool)))


def op5_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all whole documents, written to files and read back; odd input as in write_ids()."""
    return read_ids(spark, write_ids(common.load(spark, sf_dir, "documents"), common.scratch(spark, "huffman")))

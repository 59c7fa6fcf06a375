"""Removal of repeated passages by a distributed suffix array over sampled suffixes.

A byte goes if a string of `length` bytes that covers it starts earlier too. Every such string (a window) holds an
anchor: the leftmost of its shorter grams whose hash is smallest. Which it is depends on the window's bytes alone, so
equal windows have it at the same offset, and only the suffixes that start at anchors (about one byte in 25) need to be
sorted; no window is lost by that.

How it runs. Texts are read once into chunks. A chunk sorts those of its anchors' suffixes that repeat inside it and
settles their windows; of the rest it asks, by hash bucket, whether an anchor's gram occurs in another chunk at all. The
suffixes that may repeat are dealt to ranges of their leading bytes, by splitters from a sample of them. A range sorts its
suffixes by multikey quicksort, eight bytes at a time, and the bytes before them likewise from right to left; the
common prefixes of neighbours then tell, for each offset, which windows are equal, and all but the first go. Suffixes that
agree in a whole gram lie in one range, unless there are more of them than a range may hold: their windows are compared
across the ranges by a plain aggregation, whose partial results are made before the shuffle. The chunks get the
windows that repeat and give each document's spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .blocks import batch_of, by_key, packed, runs, small, unpacked

_B = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_STEP = 1 << 17


def gram_length(length: int) -> int:
    """Bytes of the grams that anchors are chosen among: half a window, and at most 64 places inside it."""
    return max(length // 2, length - 63)


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


_BYTE = _mixed((np.arange(1, 257, dtype=np.uint64) * np.uint64(_B)))


def gram_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each place on: powers of two of them at a time."""
    n = len(b) - k + 1
    now, width, got, done = _BYTE[b], 1, None, 0
    while True:
        if k & width:
            part = now[done : done + n]
            got = part.copy() if got is None else got * np.uint64(pow(_B, width, 1 << 64)) + part
            done += width
        if done == k:
            return _mixed(got)
        now = now[:-width] * np.uint64(pow(_B, width, 1 << 64)) + now[width:]
        width *= 2


def _least(v: np.ndarray, n: int) -> np.ndarray:
    """The least of each n neighbours."""
    width = 1
    while 2 * width <= n:
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    return np.minimum(v[: len(v) - (n - width)], v[n - width :]) if n > width else v


def anchors(b: np.ndarray, ends: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Place, gram hash and windows (bit o: the window that starts o bytes before) of every anchor, in parts.

    b: texts one after the other, ends: where each ends. A window lies in one text. An anchor may come in two parts.
    """
    k = gram_length(length)
    valid = np.zeros(len(b) + 1, dtype=np.int8)
    starts = np.concatenate([[0], ends[:-1]])
    has = ends - starts >= length
    np.add.at(valid, starts[has], 1)
    np.add.at(valid, ends[has] - length + 1, -1)
    valid = np.cumsum(valid, dtype=np.int8)
    bits = np.uint64((_STEP + 64).bit_length())
    for lo in range(0, len(b) - length + 1, _STEP):
        window = np.flatnonzero(valid[lo : min(lo + _STEP, len(b) - length + 1)])
        if not len(window):
            continue
        h = gram_hashes(b[lo : lo + int(window[-1]) + length], k)
        v = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
        at = (_least(v, length - k + 1)[window] & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
        new = np.flatnonzero(np.diff(at, prepend=-1))
        q, first, last = at[new], window[new], window[np.append(new[1:], len(at)) - 1]
        wide = (q - first) - (q - last)
        yield lo + q, h[q], (np.uint64(_MASK) >> (63 - wide).astype(np.uint64)) << (q - last).astype(np.uint64)


class Text:
    """Texts one after the other with room around them, so that contexts at their edges can be cut out."""

    def __init__(self, b: np.ndarray, length: int):
        self.length, self.left = length, length - gram_length(length)
        self.all = np.concatenate([np.zeros(length, np.uint8), b, np.zeros(length, np.uint8)])

    def contexts(self, q: np.ndarray) -> np.ndarray:
        """For each place the bytes before it that a window can hold, and `length` bytes from it on."""
        return np.lib.stride_tricks.sliding_window_view(self.all, self.left + self.length)[q + self.length - self.left]


def _tokens(x: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of 8-byte tokens that compare alike."""
    wide = np.zeros((len(x), -(-x.shape[1] // 8) * 8), dtype=np.uint8)
    wide[:, : x.shape[1]] = x
    return wide.view(">u8").astype(np.uint64)


def multikey_sort(x: np.ndarray) -> np.ndarray:
    """Order of rows of tokens: quicksort by the first; rows that tie in it are partitioned by the next, and so on."""
    order = np.argsort(x[:, 0])
    tied, run = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
    for j in range(1, x.shape[1]):
        same = (x[order[tied[1:]], j - 1] == x[order[tied[:-1]], j - 1]) & (run[1:] == run[:-1])
        run = np.cumsum(np.concatenate([[0], ~same])) if len(tied) else run
        keep = np.zeros(len(tied), dtype=bool)
        keep[1:] |= same
        keep[:-1] |= same
        tied, run = tied[keep], run[keep]
        if not len(tied):
            break
        order[tied] = order[tied][np.lexsort((x[order[tied], j], run))]
    return order


def common_prefixes(x: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """Bytes that each row of the order shares with the one before it (0 for the first)."""
    out = np.zeros(len(order), dtype=np.int32)
    for lo in range(1, len(order), 65_536):
        part = x[order[lo - 1 : lo + 65_536]]
        differs = part[1:] ^ part[:-1]
        at = (differs != 0).argmax(axis=1)
        value = differs[np.arange(len(at)), at]
        lead = (np.ascontiguousarray(value.astype(">u8")).view(np.uint8).reshape(-1, 8) != 0).argmax(axis=1)
        out[lo : lo + len(at)] = np.where(value == 0, width, np.minimum(8 * at + lead, width))
    return out


def repeated(context: np.ndarray, left: int, bits: np.ndarray) -> np.ndarray:
    """The windows (bits) of each anchor that an anchor of an earlier row has too. Rows are in the order that counts."""
    if len(bits) < 2:
        return np.zeros(len(bits), dtype=np.uint64)
    length, n = context.shape[1] - left, len(bits)
    sides = []
    for side, width in ((context[:, left:], length), (context[:, :left][:, ::-1], left)):
        x = _tokens(side) if width else np.zeros((n, 1), dtype=np.uint64)
        order = multikey_sort(x)
        sides.append((order, common_prefixes(x, order, width)))
    out, cls = np.zeros(n, dtype=np.uint64), np.empty((2, n), dtype=np.int64)
    for o in range(left + 1):
        rows = np.flatnonzero(bits >> np.uint64(o) & np.uint64(1))
        if len(rows) < 2:
            continue
        for side, ((order, lcp), depth) in enumerate(zip(sides, (length - o, o), strict=True)):
            cls[side, order] = np.cumsum(lcp < depth)
        for side in (0, 1):
            rows = rows[np.bincount(cls[side, rows])[cls[side, rows]] > 1]
        key = cls[0, rows] * (n + 1) + cls[1, rows]
        by = np.argsort(key, kind="stable")
        again = by[1:][key[by[1:]] == key[by[:-1]]]
        out[rows[again]] |= np.uint64(1 << o)
    return out


def _settled(text: Text, q: np.ndarray, h: np.ndarray, bits: np.ndarray, rank: np.ndarray, block: int) -> np.ndarray:
    """What repeated() says of anchors whose gram occurs twice or more among them; whole grams at a time, in blocks.

    A gram with more than `block` anchors is gone through in the order of rank, with the anchors that still have
    windows of their own carried on.
    """
    out = np.zeros(len(q), dtype=np.uint64)
    by = np.lexsort((rank, h))
    edge = np.concatenate([[0], np.flatnonzero(h[by][1:] != h[by][:-1]) + 1, [len(by)]]) if len(by) else np.array([0])
    size = np.diff(edge)
    some, at = np.flatnonzero(size > 1), 0
    while at < len(some):
        to = at + max(1, int(np.searchsorted(np.cumsum(size[some[at:]]), block, side="right")))
        rows = np.concatenate([by[edge[g] : edge[g + 1]] for g in some[at:to].tolist()])
        rows, carried, at = rows[np.argsort(rank[rows], kind="stable")], rows[:0], to
        for lo in range(0, len(rows), max(block, 1)):
            part = np.concatenate([carried, rows[lo : lo + block]])
            out[part] |= repeated(text.contexts(q[part]), text.left, bits[part] & ~out[part])
            carried = part[bits[part] & ~out[part] != 0] if lo + block < len(rows) else carried
    return out


def _marked(dup: np.ndarray, q: np.ndarray, bits: np.ndarray) -> None:
    """Set the windows that bits name, by where they start."""
    for o in range(64):
        some = (bits >> np.uint64(o) & np.uint64(1)).astype(bool)
        if some.any():
            dup[q[some].astype(np.int64) - o] = True


def _dense(b: np.ndarray, ends: np.ndarray, length: int, dup: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All anchors of a chunk with their windows that don't repeat before in the same step of it. dup: gets those that do."""
    text, parts = Text(b, length), []
    for q, h, bits in anchors(b, ends, length):
        if len(q) > _STEP // 8:  # short periods: nearly every byte is an anchor, and nearly all of them repeat
            got = _settled(text, q, h, bits, q, block)
            _marked(dup, q, got)
            left = bits & ~got
            q, h, bits = q[left != 0], h[left != 0], left[left != 0]
        parts.append((q, h, bits))
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    q, h, bits = (np.concatenate(x) for x in zip(*parts, strict=True))
    new = np.flatnonzero(np.diff(q, prepend=-1))
    return q[new], h[new], np.bitwise_or.reduceat(bits, new) if len(new) else bits


_CHUNKS = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("chunk", pa.int64()), ("blob", pa.binary()), ("anchors", pa.binary())])
_ASKED = "kind int, bucket long, chunk long, blob binary, anchors binary"
_ANSWER = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("bucket", pa.int64()), ("blob", pa.binary())])
_SENT = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("chunk", pa.int64()), ("blob", pa.binary()), ("none", pa.int32()), ("doc", pa.int64()), ("at", pa.int64())])


def _rank(doc: np.ndarray, none: np.ndarray, owner: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Places of anchors in the order of their documents (without an id first), then inside them."""
    by = np.lexsort((q, doc[owner], ~none[owner]))
    rank = np.empty(len(q), dtype=np.int64)
    rank[by] = np.arange(len(q))
    return rank


def _chunked(docs: DataFrame, length: int, n_buckets: int, sampled: int, chunk_bytes: int, block: int) -> DataFrame:
    """kind 0: a chunk's documents and texts, and its anchors; kind 1: the hashes of a chunk for a bucket; kind 2: of those
    below `sampled` the grams."""
    k = gram_length(length)

    def chunk_of(number: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = (pa.chunked_array([p.column(i) for p in parts]).combine_chunks() for i in range(2))
        none, doc = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy().astype("<i8")
        texts = texts.fill_null(b"")
        bounds = np.frombuffer(texts.buffers()[1], "<i4", len(texts) + 1, 4 * texts.offset).astype(np.int64)
        b = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        ends = bounds[1:] - bounds[0]
        dup = np.zeros(len(b), dtype=bool)
        q, h, bits = _dense(b, ends, length, dup, block)
        text = Text(b, length)
        got = _settled(text, q, h, bits, _rank(doc, none, np.searchsorted(ends, q, side="right"), q), block)
        _marked(dup, q, got)
        left = bits & ~got
        q, h, bits = q[left != 0], h[left != 0], left[left != 0]
        bucket = (h >> np.uint64(20)) % np.uint64(n_buckets)
        by = np.argsort(bucket, kind="stable")
        blob = packed(doc, none.astype(np.uint8), small(np.diff(ends, prepend=0)), b, np.packbits(dup))
        rows = [(0, 0, number, blob, packed(small(np.diff(q, prepend=0)), bits.astype("<u8"), small(bucket)))]
        yield batch_of(rows, _CHUNKS)
        rows = []
        for lo, hi in runs(bucket[by]):
            mine = h[by[lo:hi]]
            rows.append((1, int(bucket[by[lo]]), number, packed(mine.astype("<u8")), None))
            some = by[lo:hi][_mixed(mine.copy()) <= np.uint64(sampled)]
            if len(some):
                grams = text.contexts(q[some])[:, text.left : text.left + k]
                rows.append((2, int(bucket[by[lo]]), number, packed(h[some].astype("<u8"), np.ascontiguousarray(grams).reshape(-1)), None))
            if len(rows) > 500:
                yield batch_of(rows, _CHUNKS)
                rows = []
        if rows:
            yield batch_of(rows, _CHUNKS)
        common.trim()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, size = TaskContext.get().partitionId() << 24, [], 0
        for batch in batches:
            upto, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(), dtype=np.int64), 0
            while at < batch.num_rows:
                done = int(upto[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(upto, done + chunk_bytes - size, side="right")))
                parts.append(batch.slice(at, to - at))
                size, at = size + int(upto[to - 1]) - done, to
                if size >= chunk_bytes or at < batch.num_rows:
                    yield from chunk_of(number, parts)
                    number, parts, size = number + 1, [], 0
        if parts:
            yield from chunk_of(number, parts)

    return docs.mapInArrow(run, _ASKED)


def _answered(asked: DataFrame, hot_rows: int) -> DataFrame:
    """kind 0: for each hash that a chunk asked of, whether another chunk has it (2: more than hot_rows anchors do); kind 1:
    sampled grams that several chunks have, with their anchors; kind 2: how many anchors will be sent, and whether any is hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in by_key(batches):
            own = [(c, unpacked(b)[0]) for kind, c, b in rows if kind == 1]
            h, of = np.concatenate([x for _, x in own]), np.repeat(np.arange(len(own)), [len(x) for _, x in own])
            by = np.argsort(h, kind="stable")
            start = np.flatnonzero(np.concatenate([[True], h[by][1:] != h[by][:-1]]))
            size = np.diff(np.append(start, len(by)))
            several = np.minimum.reduceat(of[by], start) != np.maximum.reduceat(of[by], start)
            said = np.where(several, np.where(size > hot_rows, 2, 1), 0).astype(np.uint8)
            each, out, at = np.empty(len(h), dtype=np.uint8), [], 0
            each[by] = np.repeat(said, size)
            for c, x in own:
                if each[at : at + len(x)].any():
                    out.append((0, c, bucket, packed(each[at : at + len(x)])))
                at += len(x)
            out.append((2, int((each == 1).sum()), int((each == 2).sum()), None))
            known = h[by[start]]
            for kind, _, b in rows:
                if kind == 2:
                    some, grams = unpacked(b)
                    place = np.searchsorted(known, some)
                    yes = said[place] == 1
                    if yes.any():
                        out.append((1, 0, bucket, packed(some[yes], size[place][yes].astype("<i8"), grams.reshape(len(some), -1)[yes].reshape(-1))))
            yield batch_of(out, _ANSWER)

    rows = asked.select("bucket", "kind", "chunk", "blob").repartition("bucket").sortWithinPartitions("bucket", "kind", "chunk")
    return rows.mapInArrow(run, "kind int, chunk long, bucket long, blob binary")


def splitters(sample: list[bytes], k: int, n: int) -> np.ndarray:
    """Grams that cut the sampled ones, each counted as often as it has anchors, into n ranges."""
    parts = [unpacked(b) for b in sample]
    if not parts or n < 2:
        return np.empty(0, dtype=f"S{k}")
    h, times = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    grams = np.concatenate([p[2] for p in parts]).reshape(-1, k)
    first = np.unique(h, return_index=True)[1]
    grams, times = np.ascontiguousarray(grams[first]).view(f"S{k}").ravel(), times[first]
    by = np.argsort(grams, kind="stable")
    upto = np.cumsum(times[by])
    return np.unique(grams[by][np.minimum(np.searchsorted(upto, upto[-1] * np.arange(1, n) // n), len(by) - 1)])


def _sent(chunks: DataFrame, answers: DataFrame, cuts: np.ndarray, length: int) -> DataFrame:
    """kind 0: a chunk's suffixes of a range, with what stands before them; kind 1: single windows of hot grams."""
    shared, k = chunks.sparkSession.sparkContext.broadcast(cuts), gram_length(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in by_key(batches):
            said = {bucket: unpacked(blob)[0] for _, bucket, blob, more in rows if more is None}
            if not said:
                continue
            *_, blob, more = rows[-1]
            doc, none, sizes, b, _ = unpacked(blob)
            steps, bits, bucket = unpacked(more)
            q, ends, text = np.cumsum(steps, dtype=np.int64), np.cumsum(sizes, dtype=np.int64), Text(b, length)
            each, by = np.zeros(len(q), dtype=np.uint8), np.argsort(bucket, kind="stable")
            for lo, hi in runs(bucket[by]):
                if (got := said.get(int(bucket[by[lo]]))) is not None:
                    each[by[lo:hi]] = got
            some = np.flatnonzero(each == 1)
            lead = np.ascontiguousarray(text.contexts(q[some])[:, text.left : text.left + k]).view(f"S{k}").ravel()
            rng = np.searchsorted(shared.value, lead, side="right")
            some, by = some, np.lexsort((lead, rng))
            out, held = [], 0
            for lo, hi in runs(rng[by]):
                mine = some[by[lo:hi]]
                owner = np.searchsorted(ends, q[mine], side="right")
                out.append((0, int(rng[by[lo]]), number, packed(small(q[mine]), bits[mine].astype("<u8"), doc[owner].astype("<i8"), none[owner], text.contexts(q[mine]).reshape(-1)), None, None, None))
                held += len(out[-1][3])
                if held > 4 << 20:
                    yield batch_of(out, _SENT)
                    out, held = [], 0
            if out:
                yield batch_of(out, _SENT)
            hot = np.flatnonzero(each == 2)
            for o in range(text.left + 1):
                at = q[hot[(bits[hot] >> np.uint64(o) & np.uint64(1)).astype(bool)]] - o
                owner = np.searchsorted(ends, at, side="right")
                for lo in range(0, len(at), 20_000):
                    p, w = at[lo : lo + 20_000], owner[lo : lo + 20_000]
                    windows = np.lib.stride_tricks.sliding_window_view(b, length)[p]
                    raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(length), len(p), [None, pa.py_buffer(np.ascontiguousarray(windows))]).cast(pa.binary())
                    fill = [pa.array(np.ones(len(p), np.int32)), pa.nulls(len(p), pa.int64()), pa.array(np.full(len(p), number, np.int64)), raw, pa.array(none[w].astype(np.int32)), pa.array(doc[w]), pa.array(p)]
                    yield pa.RecordBatch.from_arrays(fill, schema=_SENT)
            common.trim()

    whole = chunks.select("chunk", F.lit(1).alias("last"), F.lit(0).cast("long").alias("bucket"), "blob", "anchors")
    rows = whole.unionByName(answers.select("chunk", F.lit(0).alias("last"), "bucket", "blob", F.lit(None).cast("binary").alias("anchors")))
    return rows.repartition("chunk").sortWithinPartitions("chunk", "last", "bucket").mapInArrow(run, "kind int, bucket long, chunk long, blob binary, none int, doc long, at long")


def _sorted_ranges(sent: DataFrame, length: int) -> DataFrame:
    """chunk and blob: the places of a chunk's anchors and the windows of each that stand earlier elsewhere."""
    left = length - gram_length(length)
    schema = pa.schema([("chunk", pa.int64()), ("blob", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(batches):
            parts = [unpacked(b) for _, b in rows]
            of = np.repeat(np.arange(len(rows)), [len(p[0]) for p in parts])
            q, bits, doc, none, context = (np.concatenate([p[i] for p in parts]) for i in range(5))
            chunk = np.array([c for c, _ in rows])[of]
            del parts
            by = np.lexsort((q, chunk, doc, 1 - none))
            context = context.reshape(len(q), -1)[by]
            got = np.empty(len(q), dtype=np.uint64)
            got[by] = repeated(context, left, bits[by])
            del context
            out = []
            for lo, hi in runs(of):
                some = lo + np.flatnonzero(got[lo:hi])
                if len(some):
                    out.append((rows[of[lo]][0], packed(small(q[some]), got[some].astype("<u8"))))
            yield batch_of(out, schema)
            common.trim()

    return sent.select("bucket", "chunk", "blob").repartition("bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(run, "chunk long, blob binary")


def _across(windows: DataFrame) -> DataFrame:
    """chunk and at of the windows of hot grams that stand earlier elsewhere."""
    order = F.struct((1 - F.col("none")).alias("some"), "doc", "chunk", "at")
    first = common.saved(windows.groupBy("blob").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1"), "first-windows")
    return windows.join(first.hint("merge"), "blob").where(order != F.col("first")).select("chunk", "at")


def repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, chunk_bytes: int = 4 << 20, bucket_anchors: int = 1_000_000, range_anchors: int = 200_000, hot_anchors: int = 200_000, sample: int = 20_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, without the bytes that a string of `length` bytes covers
    which also starts earlier; with_text adds `spans` (start and end of each removed run, in bytes) and `kept` (binary).

    Earlier is: in a row of a smaller id, or before it in the same row. A null id comes first. Rows that share an id count
    in the order in which the table is read, so of rows that repeat one keeps its text. Null texts count as empty; texts
    shorter than `length` never match. Strings are judged on the input. Other columns are ignored. An empty table gives no
    rows. Only the place of the splitters is sampled (about `sample` grams); every suffix goes to a range.
    """
    if length < 2:
        raise ValueError("length must be 2 or more")
    spark, k = docs.sparkSession, gram_length(length)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    expected = 2 * int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (length - k + 2)
    n_buckets, sampled = max(1, -(-expected // bucket_anchors)), min(_MASK, _MASK * sample // max(expected, 1))
    made = common.saved(_chunked(rows, length, n_buckets, sampled, chunk_bytes, range_anchors), "suffix-chunks", "kind")
    chunks = made.where("kind = 0")
    answers = common.saved(_answered(made.where("kind <> 0"), hot_anchors), "suffix-answers", "kind")
    total, hot = (int(x or 0) for x in answers.where("kind = 2").agg(F.sum("chunk"), F.sum("bucket")).first())
    cuts = splitters([r[0] for r in answers.where("kind = 1").select("blob").collect()], k, -(-total // range_anchors))
    common.discard_part(made, "kind=1")
    common.discard_part(made, "kind=2")
    common.release(spark)
    sent = _sent(chunks, answers.where("kind = 0"), cuts, length)
    if hot:  # read twice
        sent = common.saved(sent, "suffixes", "kind")
        common.release(spark)
    found = _sorted_ranges(sent.where("kind = 0"), length).select("chunk", F.lit(0).alias("last"), "blob", F.lit(None).cast("long").alias("at"))
    if hot:
        found = found.unionByName(_across(sent.where("kind = 1")).select("chunk", F.lit(0).alias("last"), F.lit(None).cast("binary").alias("blob"), "at"))
    found = common.saved(found, "repeated-windows")
    del sent
    common.release(spark)
    both = chunks.select("chunk", F.lit(1).alias("last"), "blob", F.lit(None).cast("long").alias("at")).unionByName(found)
    return _documents(both.repartition("chunk").sortWithinPartitions("chunk", "last"), length, with_text)


def _documents(rows: DataFrame, length: int, with_text: bool) -> DataFrame:
    """The rows of the result from each chunk's texts and the windows that repeat."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), *([("spans", span), ("kept", pa.binary())] if with_text else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in by_key(batches):
            *found, (_, blob, _) = group
            doc, none, sizes, b, marks = unpacked(blob)
            dup = np.unpackbits(marks, count=len(b)).astype(bool)
            for _, part, at in found:
                if part is None:
                    dup[at] = True
                else:
                    _marked(dup, *unpacked(part))
            seen = np.cumsum(np.concatenate([[0], dup]), dtype=np.int32)
            gone = seen[1:].copy()
            gone[length:] -= seen[1:-length]
            gone = gone > 0
            ends = np.cumsum(sizes, dtype=np.int64)
            out, held = [], 0
            for i, (lo, hi) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), strict=True)):
                cut = gone[lo:hi]
                edge = np.flatnonzero(np.diff(np.concatenate([[False], cut, [False]]).astype(np.int8)))
                kept = (b[lo:hi][~cut] if len(edge) else b[lo:hi]).tobytes()
                row = (None if none[i] else int(doc[i]), hi - lo, hi - lo - len(kept), len(edge) // 2, hashlib.sha256(kept).hexdigest())
                if with_text:
                    row += ([{"start": s, "end": e} for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)], kept)
                out.append(row)
                held += len(kept) if with_text else 0
                if held > 4 << 20:
                    yield batch_of(out, schema)
                    out, held = [], 0
            if out:
                yield batch_of(out, schema)
            common.trim()

    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", spans array<struct<start: long, end: long>>, kept binary" if with_text else "")
    return rows.select("chunk", "last", "blob", "at").mapInArrow(run, ddl)


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every whole document without 100-byte strings that start earlier; odd input as in repeats()."""
    return repeats(common.load(spark, sf_dir, "documents"))

"""Katz back-off language model: Good-Turing discounted n-grams over add-one unigrams, exactly normalised.

p(w | h) = d(c) c(h, w) / C(h) for an n-gram seen in training, else a(h) p(w | h without its first word), down to
p(w) = (c(w) + 1) / (N + V + 1). d(c) is the Good-Turing discount of the n-gram's order for counts up to MAX_R, 1 above;
a(h) shares out exactly what the discounts leave among the words not seen after h.

How it runs. Texts are read once into chunks of bounded size; only a chunk's distinct words are shuffled as strings.
Words get ids by rank, so that an id tells its count by a table of the distinct counts (at most sqrt(2 N) rows). For
each order a chunk sends its distinct n-grams, sorted and compressed, to buckets by history; a history whose words
have more than their share of all tokens is dealt over several buckets by its next word. A bucket adds up the counts.
When the counts of counts are known, each bucket's counts and back-off weights are written as the table of that order;
the parts of a dealt history are summed by Spark and sent back to its buckets. To score texts, a chunk asks the buckets
of every order for its distinct n-grams; an answer is a probability or a back-off weight, and the chunk evaluates each
token by recursion over the answers. A model is a folder of these tables and scores any other texts as well.

A request holds one n-gram at least, so there are never more requests than n-grams, however small buckets' shares get.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAX_R = 5
END, BOS, UNKNOWN, FIRST = 0, 1, 2, 3  # reserved ids; words follow by descending count
_KINDS = ("<u4", "<u2", "<f8", "<i8")


# ---- blocks of numbers ---------------------------------------------------------------------------------------------


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block. Bytes of equal significance lie together, so small numbers take little room."""
    head = np.array([len(arrays), *(x for a in arrays for x in (len(a), _KINDS.index(a.dtype.str)))], dtype="<i8")
    raw = head.tobytes() + b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays)
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(blob: bytes) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], decompressed_size=int(np.frombuffer(blob, "<i8", 1)[0]), codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head, at, out = np.frombuffer(raw, "<i8", 2 * n, 8), 8 + 16 * n, []
    for size, kind in zip(head[::2].tolist(), head[1::2].tolist(), strict=True):
        width = np.dtype(_KINDS[kind]).itemsize
        planes = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(_KINDS[kind]))
        at += size * width
    return out


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype("<u4" if not len(x) or (x.min() >= 0 and x.max() < 1 << 32) else "<i8")


def _values(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that recur, as the distinct ones and places among them."""
    got, at = np.unique(x, return_inverse=True)
    return got.astype("<f8"), at.astype("<u2" if len(got) < 1 << 16 else "<u4")


def pack_grams(history: list[np.ndarray], w: np.ndarray, *more: np.ndarray) -> bytes:
    """n-grams sorted by history, then by word: distinct histories, how many words each has, and the words' steps."""
    new = np.zeros(len(w), dtype=bool)
    new[:1] = True
    for h in history:
        new[1:] |= h[1:] != h[:-1]
    at = np.flatnonzero(new)
    step = np.diff(w, prepend=0)
    step[at] = w[at]
    return packed(_small(np.diff(history[0][at], prepend=0)), *(_small(h[at]) for h in history[1:]), _small(np.diff(np.append(at, len(w)))), _small(step), *more)


def unpack_grams(blob: bytes, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct histories (order - 1 columns), how many words each has, all words, and the other arrays."""
    arrays = unpacked(blob)
    history = [np.cumsum(arrays[0], dtype=np.int64), *(a.astype(np.int64) for a in arrays[1 : order - 1])]
    n = arrays[order - 1].astype(np.int64)
    w = np.cumsum(arrays[order], dtype=np.int64)
    at = np.cumsum(n) - n
    w -= np.repeat(w[at] - arrays[order][at], n)
    return history, n, w, arrays[order + 1 :]


def _key(columns: list[np.ndarray]) -> np.ndarray:
    """A number for each row that orders rows as the columns do."""
    key = columns[0]
    for c in columns[1:]:
        width = int(c.max(initial=0)) + 1
        if int(key.max(initial=0)) >= (1 << 62) // width:
            key = np.unique(key, return_inverse=True)[1]
        key = key * width + c
    return key


def _place(asked: list[np.ndarray], known: list[np.ndarray]) -> np.ndarray:
    """Row of `known` (distinct rows in order) that equals each row of `asked`, or -1."""
    at, of, missing = np.zeros(len(asked[0]), dtype=np.int64), np.zeros(len(known[0]), dtype=np.int64), np.zeros(len(asked[0]), dtype=bool)
    for a, k in zip(asked, known, strict=True):
        width = max(int(a.max(initial=0)), int(k.max(initial=0))) + 1
        key, mine = of * width + k, at * width + a
        distinct, of = np.unique(key, return_inverse=True)
        at = np.minimum(np.searchsorted(distinct, mine), max(len(distinct) - 1, 0))
        missing |= (distinct[at] != mine) if len(distinct) else True
    return np.where(missing, -1, at)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)


def _runs(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of equal neighbours."""
    if len(x):
        edge = np.flatnonzero(np.diff(x)) + 1
        yield from zip([0, *edge.tolist()], [*edge.tolist(), len(x)], strict=True)


# ---- the model -----------------------------------------------------------------------------------------------------


@dataclass
class Model:
    """What every task needs to know; the n-gram tables lie in `path`."""

    path: str
    order: int
    n_train: int  # training tokens, with one end for each text
    train_docs: int
    n_words: int  # distinct training words
    bucket_tokens: int
    counts: np.ndarray  # the distinct counts of words, descending, and the first id of each
    starts: np.ndarray
    discounts: dict[int, np.ndarray] = field(default_factory=dict)  # by order

    @property
    def n_buckets(self) -> int:
        return max(1, -(-self.n_train // self.bucket_tokens))

    @property
    def size(self) -> float:
        return self.n_train + self.n_words + (self.train_docs > 0) + 1.0

    def count_of(self, i: np.ndarray) -> np.ndarray:
        """Training count of ids (BOS: as a history)."""
        if not len(self.starts):
            return np.where(i <= BOS, self.train_docs, 0)
        got = self.counts[np.maximum(np.searchsorted(self.starts, i, side="right") - 1, 0)]
        return np.where(i >= FIRST, got, np.where(i <= BOS, self.train_docs, 0))

    def unigram(self, i: np.ndarray) -> np.ndarray:
        return (self.count_of(i) + 1) / self.size

    def parts(self, history: list[np.ndarray]) -> np.ndarray:
        """Over how many buckets a history is dealt: no history occurs more often than its rarest word."""
        return 1 + 4 * np.minimum.reduce([self.count_of(h) for h in history]) // self.bucket_tokens

    def bucket(self, history: list[np.ndarray], part: np.ndarray) -> np.ndarray:
        h = part.astype(np.uint64)
        for x in history:
            h = mixed(h * np.uint64(0xD1342543DE82EF95) + x.astype(np.uint64) + np.uint64(1))
        return (h % np.uint64(self.n_buckets)).astype(np.int64)


def discounts(n: np.ndarray) -> np.ndarray:
    """d(0..MAX_R) from the counts of counts n(0..MAX_R + 1); d(r) = r* / r corrected so that larger counts need none.

    Where the Katz formula isn't between 0 and 1 (too few data), (r - 0.5) / r is taken.
    """
    d = np.ones(MAX_R + 1)
    tail = (MAX_R + 1) * n[MAX_R + 1] / n[1] if n[1] else 1.0
    for r in range(1, MAX_R + 1):
        got = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and tail < 1 else -1.0
        d[r] = got if 0 < got < 1 else (r - 0.5) / r
    return d


def backoff(types: np.ndarray, large: np.ndarray, lower: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(back-off weight, denominator) of histories seen in training. types: (histories, MAX_R) numbers of words with
    count 1..MAX_R; large: what larger counts add up to; lower: what the seen words have in the shorter model. A history
    without any discounted count gets one more event, so that something is left."""
    r = np.arange(1, MAX_R + 1)
    total = (types * r).sum(axis=1) + large
    below = np.where(types.sum(axis=1) > 0, total, total + 1.0)
    return (1 - ((types * r * d[1:]).sum(axis=1) + large) / below) / np.maximum(1 - lower, 1e-300), below


# ---- texts as chunks of ids ----------------------------------------------------------------------------------------


def chunks(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """Rows of kind 0 (a chunk's documents and word sequences) and kind 1 (a distinct word of a chunk, its training count)."""
    names = ["kind", "chunk", "word", "local", "n", "blob"]

    def chunk_of(number: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, held, text = (pa.chunked_array([p.column(i) for p in parts]).combine_chunks() for i in range(3))
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(text, "")))
        words, owner = lists.flatten(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
        some = pc.greater(pc.binary_length(words), 0)
        found, owner = words.filter(some).dictionary_encode(), owner[some.to_numpy(zero_copy_only=False)]
        flat, out = found.indices.to_numpy(), held.to_numpy()
        train = np.bincount(flat[out[owner] == 0], minlength=len(found.dictionary))
        blob = packed(doc.fill_null(0).to_numpy().astype("<i8"), doc.is_null().to_numpy(zero_copy_only=False).astype("<u2"), out.astype("<u2"), np.bincount(owner, minlength=len(lists)).astype("<u4"), flat.astype("<u4"))
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([number], pa.int64()), pa.array([None], pa.string()), pa.array([0], pa.int32()), pa.array([0], pa.int64()), pa.array([blob], pa.binary())], names)
        for lo in range(0, len(found.dictionary), 100_000):
            part = found.dictionary.slice(lo, 100_000)
            m = len(part)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), pa.array(np.full(m, number, np.int64)), part, pa.array(np.arange(lo, lo + m, dtype=np.int32)), pa.array(train[lo : lo + m].astype(np.int64)), pa.nulls(m, pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, size = TaskContext.get().partitionId() << 24, [], 0
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(), dtype=np.int64)
            at = 0
            while at < batch.num_rows:
                done = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + chunk_bytes - size, side="right")))
                parts.append(batch.slice(at, to - at))
                size, at = size + int(ends[to - 1]) - done, to
                if size >= chunk_bytes or at < batch.num_rows:
                    yield from chunk_of(number, parts)
                    number, parts, size = number + 1, [], 0
        if parts:
            yield from chunk_of(number, parts)
        parts = []
        common.trim()

    return docs.mapInArrow(run, "kind int, chunk long, word string, local int, n long, blob binary")


def vocabulary(found: DataFrame, path: str) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Training words with ids by descending count, written to path; the distinct counts and the first id of each."""
    spark = found.sparkSession
    counted = common.saved(found.groupBy("word").agg(F.sum("n").alias("c")).where("c > 0"), "counted")
    steps = counted.groupBy("c").agg(F.count("*").alias("m")).orderBy(F.desc("c")).toPandas()
    counts, starts = steps["c"].to_numpy(dtype=np.int64), FIRST + np.cumsum(steps["m"].to_numpy(dtype=np.int64)) - steps["m"].to_numpy(dtype=np.int64)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))], ["word", "c", "part", "at"])
            at += n

    ordered = common.saved(counted.orderBy(F.desc("c"), "word").mapInArrow(number, "word string, c long, part int, at long"), "ordered")
    base, at = {}, FIRST
    for r in sorted(ordered.groupBy("part").agg(F.count("*").alias("n")).collect()):
        base[r["part"]], at = at, at + r["n"]
    bases = F.create_map(*[F.lit(x) for kv in (base or {0: FIRST}).items() for x in kv])
    ordered.select("word", "c", (bases[F.col("part")] + F.col("at")).cast("long").alias("id")).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path), counts, starts


def numbered(sequences: DataFrame, found: DataFrame, words: DataFrame) -> DataFrame:
    """chunk and blob: a chunk's documents, its distinct ids in order, and its word sequences as places among them."""
    # a word that is in every chunk is hot here; both sides are plain shuffles, which AQE may split
    ids = found.select("chunk", "word", "local").join(words.select("word", "id").hint("merge"), "word", "left").select("chunk", F.lit(0).alias("kind"), "local", F.coalesce("id", F.lit(UNKNOWN)).cast("long").alias("id"), F.lit(None).cast("binary").alias("blob"))
    both = ids.unionByName(sequences.select("chunk", F.lit(1).alias("kind"), F.lit(0).alias("local"), F.lit(0).cast("long").alias("id"), "blob"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            chunk, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi in _runs(chunk):
                if chunk[lo] != now:
                    now, parts = int(chunk[lo]), []
                low = lo + int(np.searchsorted(kind[lo:hi], 1))
                parts.append(batch.column(3).to_numpy()[lo:low])
                for r in range(low, hi):
                    doc, none, out, sizes, flat = unpacked(batch.column(4)[r].as_py())
                    table, at = np.unique(np.concatenate([[END, BOS], *parts]), return_inverse=True)
                    blob = packed(doc, none, out, sizes, _small(np.diff(table, prepend=0)), at[2:][flat].astype("<u4"))
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([blob], pa.binary())], ["chunk", "blob"])

    return both.repartition("chunk").sortWithinPartitions("chunk", "kind", "local").select("chunk", "kind", "local", "id", "blob").mapInArrow(run, "chunk long, blob binary")


class Chunk:
    """A chunk's tokens: words as places in `table` (ascending ids); END closes each text, BOS stands before it."""

    def __init__(self, blob: bytes, model: Model):
        self.model = model
        self.doc, self.none, self.out, sizes, steps, flat = unpacked(blob)
        self.table = np.cumsum(steps, dtype=np.int64)
        self.sizes = sizes.astype(np.int64) + 1
        self.ends = np.cumsum(self.sizes)
        inside = np.ones(int(self.ends[-1]), dtype=bool)
        inside[self.ends - 1] = False
        self.w = np.zeros(len(inside), dtype=np.int64)  # END is at place 0, BOS at place 1
        self.w[inside] = flat

    def before(self, back: int) -> np.ndarray:
        """The word `back` places before each token, BOS before the text."""
        got = np.ones_like(self.w)
        got[back:] = self.w[:-back]
        first = np.minimum(self.ends - self.sizes + back, self.ends)
        for k in range(back):
            got[(self.ends - self.sizes + k)[self.ends - self.sizes + k < first]] = 1
        return got

    def grams(self, order: int, trained: bool) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Distinct n-grams of the tokens (of training texts alone, if trained) by bucket, history and word: history
        columns, words, buckets, and for each token of those texts the place of its n-gram."""
        pick = np.repeat(self.out == 0, self.sizes) if trained else slice(None)
        columns = [*(self.before(b)[pick] for b in range(order - 1, 0, -1)), self.w[pick]]
        _, first, at = np.unique(_key(columns), return_index=True, return_inverse=True)
        *history, w = (self.table[c[first]] for c in columns)
        parts = self.model.parts(history)
        bucket = self.model.bucket(history, np.where(parts > 1, mixed(w) % np.maximum(parts, 1).astype(np.uint64), 0))
        by = np.argsort(bucket, kind="stable")
        place = np.empty(len(by), dtype=np.int64)
        place[by] = np.arange(len(by))
        return [h[by] for h in history], w[by], bucket[by], place[at]


# ---- requests and answers ------------------------------------------------------------------------------------------


def _by_chunk(sequences: DataFrame, answers: DataFrame | None, model: Model, use: Callable, schema: str) -> DataFrame:
    """use(chunk number, Chunk, {order: answers to its n-grams}) for every chunk, as batches of `schema`."""
    shared = sequences.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, got = None, {}
        for batch in batches:
            for chunk, order, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if chunk != now:
                    now, got = chunk, {}
                if order:
                    values, at = unpacked(blob.as_py())
                    got.setdefault(order, []).append(values[at])
                else:
                    yield from use(chunk, Chunk(blob.as_py(), shared.value), {k: np.concatenate(v) for k, v in got.items()})
                    got = {}
                    common.trim()

    rows = sequences.select("chunk", F.lit(0).alias("order"), "blob")
    if answers is not None:
        rows = sequences.select("chunk", F.lit(0).alias("order"), F.lit(0).cast("long").alias("bucket"), "blob").unionByName(answers.select("chunk", "order", "bucket", "blob"))
        rows = rows.repartition("chunk").sortWithinPartitions("chunk", F.desc("order"), "bucket").select("chunk", "order", "blob")
    return rows.mapInArrow(run, schema)


def _sent(chunk: int, history: list[np.ndarray], w: np.ndarray, bucket: np.ndarray, *more: np.ndarray) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for lo, hi in _runs(bucket):
        rows.append((int(bucket[lo]), chunk, pack_grams([h[lo:hi] for h in history], w[lo:hi], *(x[lo:hi] for x in more))))
        if len(rows) == 1000 or hi == len(bucket):
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], ["bucket", "chunk", "blob"])
            rows = []


REQUEST = "bucket long, chunk long, blob binary"


def asked(sequences: DataFrame, model: Model, order: int, trained: bool) -> DataFrame:
    """Every chunk's distinct n-grams of an order, by bucket (of training texts alone, if trained)."""

    def use(number: int, chunk: Chunk, _: dict) -> Iterator[pa.RecordBatch]:
        history, w, bucket, _ = chunk.grams(order, trained)
        yield from _sent(number, history, w, bucket)

    return _by_chunk(sequences, None, model, use, REQUEST)


def counted(sequences: DataFrame, answers: DataFrame | None, model: Model, order: int) -> DataFrame:
    """Like asked() for training texts, with counts and, over order 2, the n-grams' probabilities in the shorter model."""

    def use(number: int, chunk: Chunk, got: dict) -> Iterator[pa.RecordBatch]:
        history, w, bucket, at = chunk.grams(order, True)
        n = np.bincount(at, minlength=len(w))
        if order == 2:
            yield from _sent(number, history, w, bucket, _small(n))
        elif len(w):
            lower = np.empty(len(w))
            lower[at] = got[order - 1][chunk.grams(order - 1, True)[3]]  # all of them are seen, so no back-off
            yield from _sent(number, history, w, bucket, _small(n), lower)

    return _by_chunk(sequences, answers, model, use, REQUEST)


def table(requests: DataFrame, model: Model, order: int) -> None:
    """Add up the counts of an order, find its discounts and back-off weights, and write its table to the model's path."""
    spark = requests.sparkSession
    shared = spark.sparkContext.broadcast(model)
    names = ["kind", "bucket", "history", "x", "blob"]
    schema = "kind int, bucket long, history array<long>, x array<double>, blob binary"

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def add_up(bucket: int, parts: list[tuple]) -> pa.RecordBatch:
        """Kind 0: the bucket's n-grams; 1: its counts of counts; 2: its part of a history that is dealt."""
        model = shared.value
        history = [np.concatenate([np.repeat(p[0][k], p[1]) for p in parts]) for k in range(order - 1)]
        w = np.concatenate([p[2] for p in parts])
        n = np.concatenate([p[3][0] for p in parts]).astype(np.int64)
        key = _key([*history, w])
        by = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[by], prepend=-1))
        c, pick = np.add.reduceat(n[by], first), by[first]
        w, history = w[pick], [h[pick] for h in history]
        lower = model.unigram(w) if order == 2 else np.concatenate([p[3][1] for p in parts])[pick]
        del n, key, by
        new = np.zeros(len(w), dtype=bool)
        new[0] = True
        for h in history:
            new[1:] |= h[1:] != h[:-1]
        at = np.flatnonzero(new)
        stats = [np.add.reduceat((c == r).astype(float), at) for r in range(1, MAX_R + 1)]
        stats += [np.add.reduceat(np.where(c > MAX_R, c, 0).astype(float), at), np.add.reduceat(lower, at)]
        rows = [(0, bucket, None, None, pack_grams(history, w, _small(c), stats[-1])), (1, bucket, None, np.bincount(np.minimum(c, MAX_R + 2), minlength=MAX_R + 3)[: MAX_R + 2].astype(float).tolist(), None)]
        for i in np.flatnonzero(model.parts([h[at] for h in history]) > 1).tolist():
            rows.append((2, bucket, [int(h[at[i]]) for h in history], [float(s[i]) for s in stats], None))
        return batch_of(rows)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != now:
                    if parts:
                        yield add_up(now, parts)
                    now, parts = bucket, []
                parts.append(unpack_grams(blob.as_py(), order))
        if parts:
            yield add_up(now, parts)
        parts = []
        common.trim()

    dealt = requests.repartition(model.n_buckets, "bucket").sortWithinPartitions("bucket", "chunk").select("bucket", "blob")
    merged = common.saved(dealt.mapInArrow(merge, schema), f"merged-{order}", "kind")
    of = merged.where("kind = 1").agg(*(F.coalesce(F.sum(F.col("x")[r]), F.lit(0.0)) for r in range(MAX_R + 2))).first()
    model.discounts[order] = d = discounts(np.array(of, dtype=float))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                history, n, w, (c, lower) = unpack_grams(blob.as_py(), order)
                c, at = c.astype(np.int64), np.cumsum(n) - n
                types = np.stack([np.add.reduceat((c == r).astype(float), at) for r in range(1, MAX_R + 1)], axis=1)
                weight, below = backoff(types, np.add.reduceat(np.where(c > MAX_R, c, 0).astype(float), at), lower, d)
                out = pack_grams([np.repeat(h, n) for h in history], w, _small(c), weight, _small(below.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([bucket], pa.int64()), pa.array([out], pa.binary())], ["kind", "bucket", "blob"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A dealt history's weight and denominator, for each bucket that it is dealt to."""
        for batch in batches:
            rows: list[tuple] = []
            for history, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = [np.array([h]) for h in history]
                weight, below = backoff(np.array([x[:MAX_R]]), np.array([x[MAX_R]]), np.array([x[MAX_R + 1]]), d)
                parts = np.arange(int(shared.value.parts(words)[0]))
                blob = packed(np.array(history, dtype="<i8"), weight, below)
                rows += [(1, b, blob) for b in np.unique(shared.value.bucket([np.repeat(h, len(parts)) for h in words], parts)).tolist()]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], ["kind", "bucket", "blob"])

    whole = merged.where("kind = 2").groupBy("history").agg(F.array(*(F.sum(F.col("x")[r]) for r in range(MAX_R + 2))).alias("x"))
    made = merged.where("kind = 0").select("bucket", "blob").mapInArrow(weigh, "kind int, bucket long, blob binary")
    made.unionByName(whole.mapInArrow(spread, "kind int, bucket long, blob binary")).write.parquet(f"{model.path}/grams-{order}")
    common.discard(merged)


def answered(requests: DataFrame, model: Model, order: int) -> DataFrame:
    """For every request the answers to its n-grams: the probability of one seen in training; else the negative back-off
    weight of its history, -1 if that was not seen either."""
    spark = requests.sparkSession
    d = model.discounts[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, None
        for batch in batches:
            out: list[tuple] = []
            for bucket, kind, chunk, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                if bucket != now:
                    now, known = bucket, None
                if kind == 0:
                    history, n, w, (c, weight, below) = unpack_grams(blob.as_py(), order)
                    c, below = c.astype(np.int64), below.astype(float)
                    known = [history, n, w, c, weight.copy(), below]
                elif kind == 1 and known is None:  # a bucket where the dealt history has no word: only its weight counts
                    words, weight, below = unpacked(blob.as_py())
                    known = [[words[k : k + 1].astype(np.int64) for k in range(order - 1)], np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), weight.copy(), below.copy()]
                elif kind == 1:
                    words, weight, below = unpacked(blob.as_py())
                    at = int(_place([words[k : k + 1] for k in range(order - 1)], known[0])[0])
                    if at >= 0:
                        known[4][at], known[5][at] = weight[0], below[0]
                    else:
                        both = [np.append(h, x) for h, x in zip(known[0], words, strict=True)]
                        by = np.argsort(_key(both), kind="stable")
                        known = [[h[by] for h in both], np.append(known[1], 0)[by], known[2], known[3], np.append(known[4], weight)[by], np.append(known[5], below)[by]]
                else:
                    out.append((chunk, order, bucket, packed(*_values(answer(known, *unpack_grams(blob.as_py(), order)[:3])))))
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary())], ["chunk", "order", "bucket", "blob"])
        known = None
        common.trim()

    def answer(known: list | None, history: list[np.ndarray], n: np.ndarray, w: np.ndarray) -> np.ndarray:
        if known is None:
            return np.full(len(w), -1.0)
        at = _place(history, known[0])
        value = np.repeat(np.where(at >= 0, -known[4][at], -1.0), n)
        place = np.repeat(at, n)
        if len(known[2]):
            width = max(int(known[2].max()), int(w.max(initial=0))) + 1
            keys = np.repeat(np.arange(len(known[1])), known[1]) * width + known[2]
            mine = place * width + w
            found = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            seen = (place >= 0) & (keys[found] == mine)
            c = known[3][found[seen]]
            value[seen] = d[np.where(c > MAX_R, 0, c)] * c / known[5][place[seen]]  # d(0) is 1, as for counts over MAX_R
        return value

    grams = spark.read.schema("kind int, bucket long, blob binary").parquet(f"{model.path}/grams-{order}").select("bucket", "kind", F.lit(0).cast("long").alias("chunk"), "blob")
    rows = grams.unionByName(requests.select("bucket", F.lit(2).alias("kind"), "chunk", "blob"))
    dealt = rows.repartition(model.n_buckets, "bucket").sortWithinPartitions("bucket", "kind", "chunk").select("bucket", "kind", "chunk", "blob")
    return dealt.mapInArrow(run, "chunk long, order int, bucket long, blob binary")


# ---- the operator --------------------------------------------------------------------------------------------------


def _chunked(docs: DataFrame, held_out, chunk_bytes: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    made = common.saved(chunks(docs.select(F.col(id_col).cast("long").alias("doc"), held_out.cast("int").alias("held"), F.col(text_col).cast("string").alias("text")), chunk_bytes), "chunks", "kind")
    return made.where("kind = 0").select("chunk", "blob"), made.where("kind = 1").select("chunk", "word", "local", "n")


def _numbered(sequences: DataFrame, found: DataFrame, words: DataFrame) -> DataFrame:
    got = common.saved(numbered(sequences, found, words), "numbered")
    common.discard(sequences)
    common.release(got.sparkSession)
    return got


def _train(sequences: DataFrame, found: DataFrame, train_docs: int, path: str, order: int, bucket_tokens: int) -> tuple[Model, DataFrame]:
    """The model of the texts that are not held out, and all texts numbered."""
    spark = found.sparkSession
    if order < 2:
        raise ValueError("order must be 2 at least")
    words, counts, starts = vocabulary(found, f"{path}/words")
    common.release(spark)
    of = words.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    model = Model(path, order, int(of[1]) + train_docs, train_docs, int(of[0]), bucket_tokens, counts, starts)
    rows = _numbered(sequences, found, words)
    for k in range(2, order + 1):
        below = None if k == 2 else answered(asked(rows, model, k - 1, True), model, k - 1)
        table(counted(rows, below, model, k), model, k)
        common.release(spark)
    schema = "order int, n_train long, train_docs long, n_words long, bucket_tokens long, counts array<long>, starts array<long>, discounts array<array<double>>"
    row = (order, model.n_train, train_docs, model.n_words, bucket_tokens, counts.tolist(), starts.tolist(), [model.discounts[k].tolist() for k in range(2, order + 1)])
    spark.createDataFrame([row], schema).coalesce(1).write.parquet(f"{path}/model")
    return model, rows


def train(docs: DataFrame, path: str, order: int = 2, bucket_tokens: int = 1_000_000, chunk_bytes: int = 12 << 20, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn a model of the given order (2 or more) from all rows of docs and write it to path, a new folder.

    Null and empty texts count as one end. Rows that repeat are each learned from. Other columns are ignored.
    """
    parts = _chunked(docs, F.lit(0), chunk_bytes, id_col, text_col)
    model, rows = _train(*parts, docs.count(), path, order, bucket_tokens)
    common.discard(rows)
    return model


def load(spark: SparkSession, path: str) -> Model:
    """The model that train() wrote to path."""
    r = spark.read.parquet(f"{path}/model").first()
    numbers = (np.array(r[k], dtype=np.int64) for k in ("counts", "starts"))
    return Model(path, r["order"], r["n_train"], r["train_docs"], r["n_words"], r["bucket_tokens"], *numbers, {k: np.array(d) for k, d in enumerate(r["discounts"], 2)})


RESULT = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    def use(_: int, chunk: Chunk, got: dict) -> Iterator[pa.RecordBatch]:
        ids = chunk.table[chunk.w]
        p, start = model.unigram(ids), chunk.ends - chunk.sizes
        base = np.add.reduceat(np.log10(p), start)
        known = np.add.reduceat((model.count_of(ids) > 0).astype(np.int64), start)
        for k in range(2, model.order + 1):
            value = got[k][chunk.grams(k, False)[3]]
            p = np.where(value > 0, value, -value * p)
        columns = [pa.array(chunk.doc, mask=chunk.none == 1), pa.array(chunk.out == 1), pa.array(chunk.sizes), pa.array(known), pa.array(np.full(len(known), model.n_train)), pa.array(base), pa.array(np.add.reduceat(np.log10(p), start))]
        yield pa.RecordBatch.from_arrays(columns, list(RESULT))

    answers = None
    for k in range(2, model.order + 1):
        got = answered(asked(rows, model, k, False), model, k)
        answers = got if answers is None else answers.unionByName(got)
    return _by_chunk(rows, answers, model, use, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(docs: DataFrame, model: Model, chunk_bytes: int = 12 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """RESULT of every row of docs by a trained model; held_out is true. Null texts count as empty: their only token is
    the end. Rows that repeat an id or a text are each scored. Other columns are ignored."""
    parts = _chunked(docs, F.lit(1), chunk_bytes, id_col, text_col)
    return _scored(_numbered(*parts, docs.sparkSession.read.parquet(f"{model.path}/words")), model)


def train_and_score(docs: DataFrame, path: str, modulus: int = 7, held: int = 2, order: int = 2, bucket_tokens: int = 1_000_000, chunk_bytes: int = 12 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """RESULT of every row of docs, by a model of a part of them that is written to path; texts are read once.

    Training texts are those whose crc32 of the id as text modulo `modulus` isn't `held`; a row without an id is never
    learned from and counts as held out. Null texts count as empty. Rows that repeat an id or a text are each learned
    from and scored. An empty table gives no rows; without a training text every probability is 1. Other columns are
    ignored.
    """
    held_out = F.coalesce((common.crc_bucket(F.col(id_col), modulus) == held).cast("int"), F.lit(1))
    parts = _chunked(docs, held_out, chunk_bytes, id_col, text_col)
    model, rows = _train(*parts, docs.where(held_out == 0).count(), path, order, bucket_tokens)
    return _scored(rows, model)


def op7_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all whole documents by a model of those that aren't held out; odd input as in train_and_score()."""
    return train_and_score(common.load(spark, sf_dir, "documents"), common.scratch(spark, "katz"))

"""Phrases whose words go together, from exact counts by direct-address tiling.

Words that are frequent enough get ids by falling count, language by language. A pair of ids is a cell of a square matrix
that is cut into tiles; as ids are ranks, what occurs most lies in few tiles. A tile with many occurrences is counted
into a dense array by np.bincount, its cells are their own addresses; all others together are sorted coordinates. Pairs
that are frequent enough are ranked again and become ids themselves: two of them that overlap in all but a word make a
phrase one word longer, up to the longest.

How it runs. Texts are read once into chunks of one language; only a chunk's distinct words are shuffled as text, to buckets
that add them up and answer with their ids. At each length a chunk counts its own pairs and sends the distinct ones to buckets, which add them up; a tile is dealt over as many
buckets as its share of all pairs asks for, by cell, so the commonest words don't meet in one task. Buckets look up
the new ids for what each chunk asked. Counts of all first and last parts of a phrase follow it along the joins of the
tables, so that scores need no further pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .blocks import batch_of, by_key, packed, runs, small, unpacked

_SPACES = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\x0a\x0b\x0c\x0d\x09", bytes(range(97, 123)) + b"\n" * 10 + b" ")


# ---- counting ------------------------------------------------------------------------------------------------------


def tile_counts(a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None, tile: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of ids (1 or more), how often each occurs (each occurrence counts n) and for each occurrence its pair.

    Tiles of at least an eighth as many occurrences as cells are counted directly, the others as sorted coordinates.
    """
    a, b = a.astype(np.int64) - 1, b.astype(np.int64) - 1
    side = int(b.max(initial=0)) // tile + 1
    of = (a // tile) * side + b // tile
    cell = (a % tile) * tile + b % tile
    place = np.empty(len(a), dtype=np.int64)
    tiles, sizes = np.unique(of, return_counts=True)
    parts, done = [], 0
    rest = np.ones(len(a), dtype=bool)
    for t in tiles[sizes * 8 >= tile * tile].tolist():
        rows = np.flatnonzero(of == t)
        rest[rows] = False
        dense = np.bincount(cell[rows], None if n is None else n[rows])
        met = np.flatnonzero(np.bincount(cell[rows]))
        address = np.zeros(len(dense), dtype=np.int64)
        address[met] = np.arange(len(met))
        place[rows] = done + address[cell[rows]]
        parts.append((np.full(len(met), t), met, dense[met].astype(np.int64)))
        done += len(met)
    rows = np.flatnonzero(rest)
    if len(rows):
        key, inverse = np.unique(of[rows] * (tile * tile) + cell[rows], return_inverse=True)
        counts = np.bincount(inverse, None if n is None else n[rows]).astype(np.int64)
        place[rows] = done + inverse
        parts.append((key // (tile * tile), key % (tile * tile), counts))
    if not parts:
        none = np.empty(0, dtype=np.int64)
        return none, none, none, place
    t, cells, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    return (t // side) * tile + cells // tile + 1, (t % side) * tile + cells % tile + 1, counts, place


@dataclass
class Layout:
    """How the pairs of one length are dealt to buckets: by language the occurrences of the ids of each tile."""

    n_buckets: int
    bucket_pairs: int
    tile: int
    mass: dict[str, np.ndarray]

    def bucket(self, lang: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        mass = self.mass[lang]
        i, j = (a - 1) // self.tile, (b - 1) // self.tile
        expected = mass[i] * (mass[j] / max(mass.sum(), 1.0))
        parts = 1 + (expected / self.bucket_pairs).astype(np.int64)
        x = (i * len(mass) + j).astype(np.uint64) * np.uint64(1 << 20) + (_hashed(a * 1_000_003 + b) % parts.astype(np.uint64))
        return (_hashed(x + np.uint64(len(lang))) % np.uint64(self.n_buckets)).astype(np.int64)


def _hashed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


def kept_runs(ids: np.ndarray) -> np.ndarray:
    """ids without those that have no neighbour, and with one 0 between runs."""
    some = np.concatenate([[False], ids > 0, [False]])
    keep = some[1:-1] & (some[:-2] | some[2:])
    after = np.zeros(len(ids), dtype=bool)
    after[1:] = keep[:-1] & ~keep[1:]
    return np.where(keep, ids, 0)[keep | after]


def _pairs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ids that a pair starts at, and its two ids."""
    at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    return at, ids[at], ids[at + 1]


# ---- chunks --------------------------------------------------------------------------------------------------------


def words_of(text: bytes) -> tuple[pa.Array, np.ndarray]:
    """Distinct words of translated text (pieces end at newlines), and all words as places among them plus 1, 0 between pieces."""
    b = np.frombuffer(text, np.uint8)
    inside = np.concatenate([[False], (b != 32) & (b != 10), [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype("<i4")
    found = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(b[inside[1:-1]]))).dictionary_encode()
    piece = np.cumsum(b == 10, dtype=np.int32)[start]
    broken = np.diff(piece, prepend=piece[:1]) > 0
    ids = np.zeros(len(start) + int(broken.sum()), dtype=np.int64)
    ids[np.arange(len(start)) + np.cumsum(broken)] = found.indices.to_numpy() + 1
    return found.dictionary, ids


_STEP = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("chunk", pa.int64()), ("lang", pa.string()), ("blob", pa.binary())])
_STEPS = "kind int, bucket long, chunk long, lang string, blob binary"


def _joined(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"\n".join(words), np.uint8)


def _read(docs: DataFrame, chunk_bytes: int, n_buckets: int) -> DataFrame:
    """kind 0: a chunk's language and words, numbered by bucket, and how many distinct ones each bucket has; kind 1: those of
    a bucket with their counts."""

    def chunk_of(number: int, lang: str, parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        found, ids = words_of(b"\n".join(parts))
        if not len(found):
            return
        words = np.array(found.cast(pa.binary()).to_pylist(), dtype=object)
        bucket = (pd.util.hash_array(words, categorize=False) % np.uint64(n_buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        moved = np.zeros(len(by) + 1, dtype=np.int64)
        moved[by + 1] = np.arange(1, len(by) + 1)
        ids = moved[ids]
        counts, (some, sizes) = np.bincount(ids, minlength=len(by) + 1)[1:], np.unique(bucket, return_counts=True)
        rows = [(0, None, number, lang, packed(small(ids), small(some), small(sizes)))]
        for b, lo, hi in zip(some.tolist(), (np.cumsum(sizes) - sizes).tolist(), np.cumsum(sizes).tolist(), strict=True):
            rows.append((1, b, number, lang, packed(_joined(words[by[lo:hi]].tolist()), small(counts[lo:hi]))))
        yield batch_of(rows, _STEP)
        common.trim()

    def pieces(text: bytes) -> Iterator[bytes]:
        """A long text in parts that end where a piece does."""
        at = 0
        while len(text) - at > chunk_bytes:
            cut = text.rfind(b"\n", at, at + chunk_bytes) + 1 or text.find(b"\n", at + chunk_bytes) + 1 or len(text)
            cut = cut if cut > at else len(text)
            yield text[at:cut]
            at = cut
        yield text[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, sizes = TaskContext.get().partitionId() << 24, {}, {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for piece in pieces((text.as_py() or b"").translate(_SPACES)):
                    parts.setdefault(lang, []).append(piece)
                    sizes[lang] = sizes.get(lang, 0) + len(piece)
                    while sizes.get(lang, 0) >= chunk_bytes or sum(sizes.values()) >= 2 * chunk_bytes:
                        most = max(sizes, key=sizes.get)
                        yield from chunk_of(number, most, parts.pop(most))
                        del sizes[most]
                        number += 1
        for lang, part in parts.items():
            yield from chunk_of(number, lang, part)
            number += 1

    return docs.mapInArrow(run, _STEPS)


_ANSWER = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("blob", pa.binary())])
_WORDS = pa.schema([("bucket", pa.int64()), ("lang", pa.string()), ("word", pa.binary()), ("c", pa.int64())])


def _word_sums(asked: DataFrame, least: int) -> DataFrame:
    """bucket, lang, word, c of words that occur `least` times or more, and a row without a word for all words of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in by_key(batches):
            for lo, hi in runs(np.array([r[0] for r in rows])):
                parts = [unpacked(r[2]) for r in rows[lo:hi]]
                words = pa.array([w for p in parts for w in p[0].tobytes().split(b"\n")], pa.binary()).dictionary_encode()
                sums = np.bincount(words.indices.to_numpy(), np.concatenate([p[1] for p in parts])).astype(np.int64)
                some = np.flatnonzero(sums >= least)
                m = len(some) + 1
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, bucket)), pa.array([rows[lo][0]] * m), pa.array([None, *words.dictionary.take(pa.array(some)).to_pylist()], pa.binary()), pa.array(np.append(sums.sum(), sums[some]))], schema=_WORDS)
        common.trim()

    rows = asked.select("bucket", "lang", "chunk", "blob").repartition("bucket").sortWithinPartitions("bucket", "lang", "chunk")
    return rows.mapInArrow(run, "bucket long, lang string, word binary, c long")


def _word_ids(asked: DataFrame, level: DataFrame) -> DataFrame:
    """chunk, bucket, blob: the ids (0: not frequent) of a chunk's words of a bucket. level: bucket, lang, word, id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in by_key(batches):
            for lo, hi in runs(np.array([r[0] for r in rows])):
                known = {word: i for _, chunk, _, word, i in rows[lo:hi] if chunk is None}
                out = []
                for _, chunk, blob, *_ in rows[lo + len(known) : hi] if known else []:
                    ids = np.array([known.get(w, 0) for w in unpacked(blob)[0].tobytes().split(b"\n")], dtype=np.int64)
                    if ids.any():
                        out.append((chunk, bucket, packed(small(ids))))
                yield batch_of(out, _ANSWER)

    none = lambda **types: [F.lit(None).cast(t).alias(c) for c, t in types.items()]
    rows = asked.select("bucket", "lang", "chunk", "blob", *none(word="binary", id="long")).unionByName(level.select("bucket", "lang", *none(chunk="long", blob="binary"), "word", "id"))
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "lang", F.asc_nulls_first("chunk"))
    return rows.mapInArrow(run, "chunk long, bucket long, blob binary")


def ranked(rows: DataFrame, *ties: str) -> DataFrame:
    """rows (lang, c, ...) with an id from 1 in each language by falling c, then by ties; written out.

    They are sorted in ranges; where a range begins among its language's ids follows from a count for each range and
    language, of which there are at most as many as ranges and languages together: these are broadcast.
    """
    placed = common.saved(rows.orderBy("lang", F.desc("c"), *ties).withColumn("m", F.monotonically_increasing_id()).withColumn("part", F.shiftright("m", 33)), "ranked")
    bases = placed.groupBy("lang", "part").agg(F.min("m").alias("low"), F.count("*").alias("k"))
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = bases.withColumn("base", F.coalesce(F.sum("k").over(before), F.lit(0))).drop("k")
    return placed.join(F.broadcast(bases), ["lang", "part"]).withColumn("id", F.col("base") + F.col("m") - F.col("low") + 1).drop("m", "part", "low", "base")


def _layout(level: DataFrame, bucket_pairs: int, tile: int) -> Layout:
    """level: lang, id, c of all ids. A number for each tile and language comes to the driver."""
    got = level.groupBy("lang", F.floor((F.col("id") - 1) / tile).alias("t")).agg(F.sum("c").alias("c")).collect()
    mass: dict[str, np.ndarray] = {}
    for lang in {r["lang"] for r in got}:
        mine = {r["t"]: float(r["c"]) for r in got if r["lang"] == lang}
        mass[lang] = np.array([mine[t] for t in range(len(mine))])
    return Layout(max(1, -(-int(sum(m.sum() for m in mass.values())) // bucket_pairs)), bucket_pairs, tile, mass)


def _cells(ids: np.ndarray, lang: str, layout: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's pairs by bucket: ids, counts and buckets, where in ids each occurrence starts, and its pair."""
    at, a, b = _pairs(ids)
    a, b, n, place = tile_counts(a, b, tile=layout.tile)
    bucket = layout.bucket(lang, a, b)
    by = np.argsort(bucket, kind="stable")
    moved = np.empty(len(by), dtype=np.int64)
    moved[by] = np.arange(len(by))
    return a[by], b[by], n[by], bucket[by], at, moved[place]


def _asked(chunk: int, lang: str, ids: np.ndarray, layout: Layout, whole: bool) -> Iterator[pa.RecordBatch]:
    """The chunk itself (kind 0, if whole) and what it asks each bucket (kind 1)."""
    ids = kept_runs(ids)
    if len(ids) < 2:
        return
    rows = [(0, None, chunk, lang, packed(small(ids)))] if whole else []
    a, b, n, bucket, _, _ = _cells(ids, lang, layout)
    for lo, hi in runs(bucket):
        rows.append((1, int(bucket[lo]), chunk, lang, packed(small(a[lo:hi]), small(b[lo:hi]), small(n[lo:hi]))))
    yield batch_of(rows, _STEP)


def _first(read: DataFrame, answers: DataFrame, layout: Layout, last: bool) -> DataFrame:
    """Chunks by ids of frequent words, and what they ask of pairs."""
    shared = read.sparkSession.sparkContext.broadcast(layout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in by_key(batches):
            *found, (whole, _, lang, blob) = rows
            if found and whole:
                ids, some, sizes = unpacked(blob)
                said = {b: blob for _, b, _, blob in found}
                table = [np.zeros(1, dtype=np.int64)]
                table += [unpacked(said[b])[0] if b in said else np.zeros(n, dtype=np.int64) for b, n in zip(some.tolist(), sizes.tolist(), strict=True)]
                yield from _asked(chunk, lang, np.concatenate(table)[ids], shared.value, not last)
                common.trim()

    return _by_chunk(read, answers).mapInArrow(run, _STEPS)


def _by_chunk(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """Rows of chunk, whole, bucket, lang, blob: a chunk's answers, then the chunk."""
    rows = chunks.select("chunk", F.lit(1).alias("whole"), F.lit(0).cast("long").alias("bucket"), "lang", "blob").unionByName(answers.select("chunk", F.lit(0).alias("whole"), "bucket", F.lit(None).cast("string").alias("lang"), "blob"))
    return rows.repartition("chunk").sortWithinPartitions("chunk", "whole", "bucket")


_SUMS = pa.schema([("bucket", pa.int64()), ("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64())])


def _summed(asked: DataFrame, least: int, tile: int) -> DataFrame:
    """bucket, lang, a, b, c of pairs that occur `least` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in by_key(batches):
            for lo, hi in runs(np.array([r[0] for r in rows])):
                parts = [unpacked(r[2]) for r in rows[lo:hi]]
                a, b, n, _ = tile_counts(*(np.concatenate([p[i].astype(np.int64) for p in parts]) for i in range(3)), tile=tile)
                some = n >= least
                m = int(some.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, bucket)), pa.array([rows[lo][0]] * m, pa.string()), pa.array(a[some]), pa.array(b[some]), pa.array(n[some])], schema=_SUMS)
        common.trim()

    rows = asked.select("bucket", "lang", "chunk", "blob").repartition("bucket").sortWithinPartitions("bucket", "lang", "chunk")
    return rows.mapInArrow(run, "bucket long, lang string, a long, b long, c long")


def _places(a: np.ndarray, b: np.ndarray, known_a: np.ndarray, known_b: np.ndarray) -> np.ndarray:
    """Row of the known pairs that equals each pair, or -1. Known pairs are distinct and sorted."""
    firsts = np.unique(known_a)
    width = max(int(b.max(initial=0)), int(known_b.max(initial=0))) + 1
    key = np.searchsorted(firsts, known_a) * width + known_b
    at = np.minimum(np.searchsorted(firsts, a), len(firsts) - 1)
    place = np.minimum(np.searchsorted(key, at * width + b), len(key) - 1)
    return np.where((firsts[at] == a) & (key[place] == at * width + b), place, -1)


def _answered(asked: DataFrame, level: DataFrame) -> DataFrame:
    """chunk, bucket, blob: the new ids (0: not frequent) of what each chunk asked. level: bucket, lang, a, b, id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in by_key(batches):
            for lo, hi in runs(np.array([r[0] for r in rows])):
                known = [r[3:6] for r in rows[lo:hi] if r[1] is None]
                if not known:
                    continue
                ka, kb, ids = (np.array(x, dtype=np.int64) for x in zip(*known, strict=True))
                out = []
                for _, chunk, blob, *_ in rows[lo + len(known) : hi]:
                    a, b, _ = (x.astype(np.int64) for x in unpacked(blob))
                    place = _places(a, b, ka, kb)
                    if (place >= 0).any():
                        out.append((chunk, bucket, packed(small(np.where(place >= 0, ids[place], 0)))))
                yield batch_of(out, _ANSWER)

    none = lambda *names: [F.lit(None).cast("binary" if c == "blob" else "long").alias(c) for c in names]
    rows = asked.select("bucket", "lang", "chunk", "blob", *none("a", "b", "id")).unionByName(level.select("bucket", "lang", *none("chunk", "blob"), "a", "b", "id"))
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "lang", F.asc_nulls_first("chunk"), "a", "b")
    return rows.mapInArrow(run, "chunk long, bucket long, blob binary")


def _next(chunks: DataFrame, answers: DataFrame, before: Layout, layout: Layout, last: bool) -> DataFrame:
    """Chunks by the ids of phrases one word longer, and what they ask of pairs of these."""
    shared = chunks.sparkSession.sparkContext.broadcast((before, layout))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old, new = shared.value
        for chunk, rows in by_key(batches):
            *found, (whole, _, lang, blob) = rows
            if not found or not whole:
                continue
            ids = unpacked(blob)[0].astype(np.int64)
            a, _, _, bucket, at, place = _cells(ids, lang, old)
            got, said = np.zeros(len(a), dtype=np.int64), {b: blob for _, b, _, blob in found}
            for lo, hi in runs(bucket):
                if int(bucket[lo]) in said:
                    got[lo:hi] = unpacked(said[int(bucket[lo])])[0]
            longer = np.zeros(len(ids), dtype=np.int64)
            longer[at] = got[place]
            yield from _asked(chunk, lang, longer, new, not last)
            common.trim()

    return _by_chunk(chunks, answers).mapInArrow(run, _STEPS)


# ---- phrases -------------------------------------------------------------------------------------------------------


def counted(docs: DataFrame, least: int = 100, longest: int = 5, lang_col: str = "lang", text_col: str = "text", chunk_bytes: int = 8 << 20, bucket_pairs: int = 1_000_000, bucket_bytes: int = 64 << 20, tile: int = 1024) -> tuple[DataFrame, list[DataFrame]]:
    """All words of each language (lang, n), and for each length from 1 to `longest` the phrases that occur `least` times or
    more: lang, id, c, phrase, last (word), firsts and lasts (counts of its first and last parts, by length), and from
    length 2 on the ids a and b of the phrase without its last and first word.
    """
    lang, text = F.coalesce(F.col(lang_col).cast("string"), F.lit("und")), F.col(text_col).cast("string").cast("binary")
    rows = docs.select(lang.alias("lang"), text.alias("text"))
    n_buckets = 1 + int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // bucket_bytes
    read = common.saved(_read(rows, chunk_bytes, n_buckets), "phrase-chunks", "kind")
    words = common.saved(_word_sums(read.where("kind = 1"), least), "words")
    totals = words.where("word is null").groupBy("lang").agg(F.sum("c").alias("n"))
    ids = ranked(words.where("word is not null"), "word")
    word = F.col("word").cast("string")
    level = common.saved(ids.withColumns({"phrase": word, "last": word, "firsts": F.array("c"), "lasts": F.array("c")}), "phrases-1")
    levels, layout = [level], _layout(level, bucket_pairs, tile)
    step = common.saved(_first(read.where("kind = 0"), common.saved(_word_ids(read.where("kind = 1"), level), "word-ids"), layout, longest == 2), "phrase-step", "kind") if longest > 1 and layout.mass else None
    for length in range(2, longest + 1):
        if step is None:
            break
        sums = common.saved(_summed(step.where("kind = 1"), least, tile), "pair-sums")
        pairs = common.saved(ranked(sums, "a", "b"), "pairs")
        side = lambda c: level.select("lang", F.col("id").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in ("phrase", "last", "firsts", "lasts"))).hint("merge")  # noqa: B023, E731
        joined = pairs.join(side("a"), ["lang", "a"]).join(side("b"), ["lang", "b"])
        level = common.saved(joined.select("lang", "id", "c", "a", "b", F.concat_ws(" ", "a_phrase", "b_last").alias("phrase"), F.col("b_last").alias("last"), F.concat("a_firsts", F.array("c")).alias("firsts"), F.concat("b_lasts", F.array("c")).alias("lasts")), f"phrases-{length}")
        levels.append(level)
        before, layout = layout, _layout(level, bucket_pairs, tile)
        if length == longest or not layout.mass:
            break
        answers = common.saved(_answered(step.where("kind = 1"), pairs), "pair-ids")
        step = common.saved(_next(step.where("kind = 0"), answers, before, layout, length + 1 == longest), "phrase-step", "kind")
        common.release(docs.sparkSession)
    return totals, levels


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of 2 to `longest` words of each language.

    Words are what white space (blanks and tabs) leaves of pieces, which end at .,;:!? and line ends; A-Z count as a-z. A
    phrase lies in a piece and occurs a >= least times. Cut after its first k words it scores floor(1000 a n / (l r)), with
    l and r the counts of its parts and n that of all words of the language; its lowest cut counts, the first of such. Phrases
    that lie in a longer one (of at most `longest` words) that occurs as often are left out. Null texts count as empty, a null
    language as `und`, and rows that repeat count each. Ties go to the larger a, then to the phrase first in UTF-8. An
    empty table gives no rows. Counts are 64 bits wide, products 38 decimal digits; beyond these Spark reports an error.
    """
    totals, levels = counted(docs, least, longest, **options)
    wide = lambda x: x.cast("decimal(38,0)")
    found = None
    for length, level in enumerate(levels[1:], 2):
        cut = [F.struct(F.expr(f"(CAST(1000 AS DECIMAL(38,0)) * wide_c * wide_n) div (CAST(firsts[{k - 1}] AS DECIMAL(38,0)) * CAST(lasts[{length - k - 1}] AS DECIMAL(38,0)))").alias("score"), F.lit(k).alias("k"), F.col("firsts")[k - 1].alias("l"), F.col("lasts")[length - k - 1].alias("r")) for k in range(1, length)]
        rows = level
        if length < len(levels):
            longer = levels[length]
            # an id is left out if a phrase one word longer occurs as often: longer ones that do have such a one inside
            as_often = lambda side: longer.select("lang", F.col(side).alias("id"), F.col("firsts" if side == "a" else "lasts")[length - 1].alias("part"), "c").where("part = c").select("lang", "id")  # noqa: B023, E731
            inside = as_often("a").unionByName(as_often("b")).distinct()
            rows = rows.join(inside.hint("merge"), ["lang", "id"], "left_anti")
        rows = rows.join(totals.hint("merge"), "lang").withColumns({"wide_c": wide(F.col("c")), "wide_n": wide(F.col("n"))})
        rows = rows.withColumn("best", F.array_min(F.array(*cut))).select("lang", "phrase", F.col("c").alias("a"), "best.l", "best.r", "n", "best.score")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return docs.sparkSession.createDataFrame([], "lang string, rank int, phrase string, a long, l long, r long, n long, score long")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return found.withColumn("rank", place).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language of all whole documents; odd input as in collocations()."""
    return collocations(common.load(spark, sf_dir, "documents")).withColumn("rank", F.col("rank").cast("long"))


def oracle_sql(least: int = 100, longest: int = 5, top: int = 2000) -> str:
    """The same rows by plain counts of all phrases, for DuckDB."""
    grams = " UNION ALL ".join(f"SELECT lang, array_to_string(w[i : i + {k - 1}], ' ') AS g, {k} AS k FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM pieces WHERE len(w) >= {k})" for k in range(1, longest + 1))
    part = lambda a, b: f"array_to_string(list_slice(string_split(c.g, ' '), {a}, {b}), ' ')"
    return f"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
pieces AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM texts),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
f AS (SELECT lang, g, k, count(*) AS a FROM ({grams}) GROUP BY lang, g, k HAVING count(*) >= {least}),
inside AS (SELECT DISTINCT c.lang, {part(1, "c.k - 1")} AS g, c.a FROM f c WHERE k > 2 UNION SELECT DISTINCT c.lang, {part(2, "c.k")} AS g, c.a FROM f c WHERE k > 2),
cuts AS (SELECT c.lang, c.g, c.k, c.a, unnest(range(1, c.k)) AS j FROM f c WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = c.lang AND i.g = c.g AND i.a = c.a)),
scored AS (SELECT c.lang, c.g, c.a, c.j, x.a AS l, y.a AS r, t.n, CAST((CAST(1000 AS HUGEINT) * c.a * t.n) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score FROM cuts c
  JOIN f x ON x.lang = c.lang AND x.g = {part(1, "c.j")} JOIN f y ON y.lang = c.lang AND y.g = {part("c.j + 1", "c.k")} JOIN total t ON t.lang = c.lang),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, j) AS rn FROM scored) WHERE rn = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT lang, g AS phrase, a, l, r, n, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(g)) AS rank FROM best) WHERE rank <= {top}"""

"""Near-duplicate texts: DartMinHash signatures of weighted word shingles, banded joining, exact checks.

A text is the bag of its five-word shingles. Darts are thrown at each shingle's region (its weight by rank) from the
shingle's hash alone, so equal regions of two texts hold the same darts. Each dart belongs to one of K coordinates, and
a coordinate keeps its earliest dart (lowest rank) that hits the text: two texts keep the same dart with a probability
equal to their weighted Jaccard similarity, and a text needs about K log K darts in all, however many coordinates and
shingles there are.

Equal texts are collapsed first. Bands of the signature put texts into buckets; texts that share buckets, directly or
through others, make a candidate family. Families are small or are cut into chunks that meet two at a time; the task
that holds them links two texts if their similarity, computed exactly, reaches the threshold. It skips pairs that are
linked through others already and returns the links that join classes, so large families never emit their pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .graph import components

BANDS, ROWS = 30, 6
COORDINATES = BANDS * ROWS
SHINGLE = 5
THRESHOLD = 0.8
_BASE = np.uint64(0x5851F42D4C957F2D)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, _INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _words(raw: bytes, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words between ASCII white space, in order, and where each begins."""
    at, out, places = 0, [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)]
    while at < len(raw):
        end = min(len(raw), at + block)
        if end < len(raw):  # a block ends where a word ends; a longer word gets a longer block
            cut = max(raw.rfind(c, at, end) for c in (b" ", b"\n"))
            while cut < 0 and end < len(raw):
                end = min(len(raw), end + block)
                cut = max(raw.rfind(c, at, end) for c in (b" ", b"\n"))
            end = cut + 1 if cut >= 0 else len(raw)
        b = np.frombuffer(raw, dtype=np.uint8, count=end - at, offset=at)
        inside = ~_SPACE[b]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        if len(starts):
            up, down = _powers(1 << max(16, (len(b) - 1).bit_length()))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)])])
            out.append(mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
            places.append(starts + at)
        at = end
    return np.concatenate(out), np.concatenate(places)


def word_hashes(text: str, block: int = 1 << 20) -> np.ndarray:
    """64-bit hashes of the lower-case words between ASCII white space, in order."""
    return _words(text.lower().encode("utf-8", "replace"), block)[0]


def bags(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of many texts: owner (place of the text), hash and number of each, by owner and hash. A text of fewer
    words than SHINGLE has one shingle of them all; one without a word has none."""
    raw = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    w, place = _words(b"\n".join(raw))
    owner = np.searchsorted(np.cumsum([0, *(len(r) + 1 for r in raw)]), place, side="right") - 1
    size = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(size) - size
    hashes, owners = [], []
    for n in range(1, SHINGLE + 1):
        if n < SHINGLE:
            at = first[size == n]
        else:
            at = np.flatnonzero(owner[: max(0, len(w) - n + 1)] == owner[n - 1 :])
        h = np.full(len(at), n, dtype=np.uint64)
        for j in range(n):
            h = mix(h + w[at + j])
        hashes.append(h)
        owners.append(owner[at])
    h, owner = np.concatenate(hashes), np.concatenate(owners)
    by = np.lexsort((h, owner))
    h, owner = h[by], owner[by]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], h[at], np.diff(np.append(at, len(h)))


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's shingles, ascending, and how often each occurs."""
    _, h, n = bags([text])
    return h, n


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: sum of minima over sum of maxima of the weights."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j]).sum()
    return float(least / (a[1].sum() + b[1].sum() - least)) if len(a[0]) and len(b[0]) else 0.0


@lru_cache(maxsize=64)
def _poisson(mean: float) -> np.ndarray:
    """Cumulative probabilities; from them a uniform number gives a count."""
    p, total, out, k = math.exp(-mean), 0.0, [], 0
    while total < 1 - 1e-12 and k < 20 * mean + 60:
        total += p
        out.append(total)
        k += 1
        p *= mean / k
    return np.array(out)


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)) * (1.0 / (1 << 53))


def dart_signatures(items: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, k: int = COORDINATES, width: float = 1 / 8) -> np.ndarray:
    """(n, k): the earliest dart of each of k coordinates of n bags, as 64-bit hashes; weights are positive numbers.

    Ranks are cut into bands that double in width. An element's region is cut into layers of weight 1. The number of
    darts in a layer and band is Poisson by their area; a dart's rank, weight and coordinate come from its hash, and a
    dart above the element's weight misses. Bands are thrown at a bag until each of its coordinates has a dart, and a
    dart at a coordinate that has one from an earlier band isn't looked at.
    """
    layers = np.ceil(weights).astype(np.int64)
    at = np.repeat(np.arange(len(items)), layers)
    layer = np.arange(len(at)) - np.repeat(np.cumsum(layers) - layers, layers)
    room, own = np.minimum(1.0, weights[at] - layer), owner[at]
    cell = mix(items[at] + mix(layer.astype(np.uint64) + np.uint64(0x9E37)))
    best_rank, best = np.full(n * k, np.inf), np.zeros(n * k, dtype=np.uint64)
    low, band = 0.0, 0
    while True:
        size = width * 2**band
        parts = max(1, math.ceil(size / 8))
        open_now = np.isinf(best_rank)
        for part in range(parts):
            seed = mix(cell + np.uint64(((band << 20) + part + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            count = np.searchsorted(_poisson(size / parts), _unit(seed), side="right")
            some = np.flatnonzero(count)
            who = np.repeat(some, count[some])
            order = np.arange(len(who)) - np.repeat(np.cumsum(count[some]) - count[some], count[some])
            dart = mix(seed[who] + (order + 1).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
            coordinate = own[who] * k + (mix(dart + np.uint64(2)) % np.uint64(k)).astype(np.int64)
            hit = open_now[coordinate] & (_unit(mix(dart + np.uint64(3))) < room[who])
            dart, coordinate = dart[hit], coordinate[hit]
            rank = low + (part + _unit(mix(dart + np.uint64(1)))) * (size / parts)
            better = rank < best_rank[coordinate]
            dart, coordinate, rank = dart[better], coordinate[better], rank[better]
            late = np.argsort(-rank, kind="stable")  # of darts at one coordinate the earliest is written last
            best_rank[coordinate[late]], best[coordinate[late]] = rank[late], dart[late]
        low, band = low + size, band + 1
        missing = np.isinf(best_rank).reshape(n, k).any(axis=1)
        if not missing.any():
            return best.reshape(n, k)
        if not missing.all():
            more = missing[own]
            cell, room, own = cell[more], room[more], own[more]


def dart_signature(items: np.ndarray, weights: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    return dart_signatures(items, weights, np.zeros(len(items), dtype=np.int64), 1, k)[0]


def worded(text_col: str = "text") -> Column:
    """Texts that have a word."""
    return F.coalesce(F.col(text_col).rlike("[^ \t\n\u000b\f\r]"), F.lit(False))


def digest(text_col: str = "text") -> Column:
    """128 bits that stand for a text where equal texts are collapsed."""
    return F.unhex(F.md5(text_col))


def signatures(texts: DataFrame, together: int = 1 << 18) -> DataFrame:
    """doc_id, digest and text to doc_id, digest, bands (64-bit hashes) and sig (16 bits of each coordinate). Every text
    must have a word. Texts of about `together` characters are worked on at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = (np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            size, at = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(), dtype=np.int64), 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + together, side="right")))
                n = to - at
                owner, items, counts = bags(batch.column(2).slice(at, n).to_pylist())
                sig = dart_signatures(items, counts, owner, n)
                h = np.repeat(salt[None], n, axis=0)
                for j in range(ROWS):
                    h = mix(h + sig[:, j::ROWS])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(h.ravel().astype(np.int64)))
                short = [x.tobytes() for x in (sig & np.uint64(0xFFFF)).astype("<u2")]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(1).slice(at, n), lists, pa.array(short, pa.binary())], ["doc_id", "digest", "bands", "sig"])
                at = to
            common.trim()

    return texts.select("doc_id", "digest", "text").mapInArrow(run, "doc_id long, digest binary, bands array<long>, sig binary")


def _links(group: list[tuple], threshold: float, slack: float | None = 4.0) -> list[tuple[int, int]]:
    """Links that join classes among the texts of two chunks (side 0 and 1; pairs within a side only if it stands alone).

    Pairs whose signatures agree in `slack` standard deviations less than the threshold asks for aren't compared; with
    slack None all pairs of the chunks are.
    """
    group.sort(key=lambda r: (r[0], r[1]))
    side = np.array([r[0] for r in group])
    sig = np.frombuffer(b"".join(r[2] for r in group), dtype="<u2").reshape(len(group), -1)
    enough = 0 if slack is None else int(COORDINATES * (threshold - slack * math.sqrt(threshold * (1 - threshold) / COORDINATES)))
    alone = side.max() == side.min()
    known: dict[int, tuple] = {}
    parent = list(range(len(group)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def weights(x: int) -> tuple:
        if x not in known:
            known[x] = shingles(group[x][3])
        return known[x]

    out, pairs = [], []
    for i in range(len(group) - 1):
        if not alone and side[i] == 1:
            break
        lo = i + 1 if alone else int(np.searchsorted(side, 1))
        same = (sig[lo:] == sig[i]).sum(axis=1)
        for j in np.flatnonzero(same >= enough):
            pairs.append((-int(same[j]), i, lo + int(j)))
        if len(pairs) > 200_000 or i == len(group) - 2:
            _settle(pairs, find, parent, weights, threshold, group, out)
            pairs = []
    _settle(pairs, find, parent, weights, threshold, group, out)
    return out


def _settle(pairs: list, find, parent: list[int], weights, threshold: float, group: list, out: list) -> None:
    for _, i, j in sorted(pairs):
        a, b = find(i), find(j)
        if a != b and similarity(weights(i), weights(j)) >= threshold:
            parent[max(a, b)] = min(a, b)
            out.append((group[i][1], group[j][1]))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, slack: float | None = 4.0, chunk_rows: int = 512, chunk_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, digest (of its text), class_id (smallest doc_id of its class), kept.

    Rows of equal text, and of texts linked directly or through others, are one class. Null texts, texts without a
    word, and rows without an id are classes of their own (a row without an id has no class_id and is kept). Rows
    with the same id and text are all marked the same. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keys = common.saved(rows.select("doc_id", F.when(worded() & F.col("doc_id").isNotNull(), digest()).alias("digest")), "keys")
    made = signatures(rows.where(F.col("doc_id").isNotNull() & worded()).withColumn("digest", digest()))
    # a number for each text, fixed when the table is written
    sigs = made.groupBy("digest").agg(F.min("doc_id").alias("first"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    sigs = common.saved(sigs.withColumn("node", F.monotonically_increasing_id()), "sigs")
    banded = sigs.select("node", F.explode("bands").alias("band"))
    shared = common.saved(banded.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").select("band", "hub"), "bands")
    # bands of a large family are hot; both sides of this join are plain shuffles, which AQE may split
    met = banded.join(shared.hint("merge"), "band").where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    families = common.saved(components(met), "families")
    some = sigs.select("node", F.col("first").alias("doc_id"), "digest", "sig").join(families.hint("merge"), "node")
    texts = rows.where("doc_id is not null").join(some.hint("merge"), "doc_id").where(digest() == F.col("digest"))
    texts = texts.select("node", "root", "text", "sig", F.length("text").alias("size"))
    members = common.saved(texts, "members")
    sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / chunk_rows), F.ceil(F.sum("size") / chunk_bytes)).cast("int").alias("chunks"))
    sizes = common.saved(sizes, "sizes")
    # a family of one chunk is a task; of more, each two chunks and each chunk alone
    dealt = members.join(sizes.hint("merge"), "root").withColumn("c", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("root", F.least("c", "other").alias("a"), F.greatest("c", "other").alias("b"), (F.col("c") > F.col("other")).cast("int").alias("side"), "node", "sig", "text")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, found = None, [], []
        for batch in batches:
            roots, a, b, side, node = (batch.column(i).to_pylist() for i in range(5))
            for r in range(len(roots)):
                key = (roots[r], a[r], b[r])
                if key != now:
                    if len(group) > 1:
                        found += _links(group, threshold, slack)
                    now, group = key, []
                group.append((side[r], node[r], batch.column(5)[r].as_py(), batch.column(6)[r].as_py()))
            if len(found) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["u", "v"])
                found = []
        if len(group) > 1:
            found += _links(group, threshold, slack)
        group = []
        common.trim()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["u", "v"])

    links = dealt.repartition("root", "a", "b").sortWithinPartitions("root", "a", "b").mapInArrow(link, "u long, v long")
    roots = components(links)
    named = sigs.select("digest", "node", "first").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = common.saved(named.groupBy("root").agg(F.min("first").alias("class_id")), "least")
    classes = common.saved(named.join(least.hint("merge"), "root").select("digest", "class_id"), "classes")
    out = keys.join(classes.hint("merge"), "digest", "left").withColumn("class_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")))
    return out.select("doc_id", "digest", "class_id", (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("class_id"))).alias("kept"))


def deduplicate(docs: DataFrame, **how) -> DataFrame:
    """docs with one row of each class: of the smallest doc_id, and of rows alike in id and text any one. Rows without an
    id or without a word all stay."""
    columns = docs.columns
    classes = near_duplicates(docs, **how)
    keep = classes.where("kept and digest is not null").select("doc_id", F.col("digest").alias("_digest")).distinct()
    judged = F.col("doc_id").isNotNull() & worded()
    best = docs.where(judged).withColumn("_digest", digest()).join(common.saved(keep, "keep").hint("merge"), ["doc_id", "_digest"], "left_semi")
    return best.dropDuplicates(["doc_id", "_digest"]).select(*columns).unionByName(docs.where(~judged))


def op2_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all whole documents; odd input as in near_duplicates()."""
    return near_duplicates(common.load(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")

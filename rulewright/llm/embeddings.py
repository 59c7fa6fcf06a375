"""Embedding near-duplicates: a subspace pigeonhole join.

Unit vectors are rotated (a Hadamard matrix with random signs) and cut into blocks of equal size. Two vectors of
cosine >= c have a squared distance of at most 2 - 2c, so in at least one of B blocks it is at most (2 - 2c) / B: each
block is joined by that range alone, the union of the candidates holds every link, and each candidate's cosine is
checked in double precision. A block's range join goes by a tree over all of the block's coordinates, cut at medians of
a bounded sample: a vector lives in one leaf and visits those later leaves that its range reaches, as the sum of its
squared distances to the cuts on the way tells. Leaves and their visitors are cut into chunks of bounded size, and a
task joins two chunks; it returns how many links each vector has there and a spanning forest of them, never the pairs.
A pair that several blocks find counts in the first.

Vectors without structure reach most leaves, so the tree would deal each of them out many times. Where its census says that
it deals more rows than all pairs of larger chunks do, these are joined instead: one block, one leaf, the same links.

Equal vectors are collapsed to one with a weight before all this, so copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .graph import components

BLOCKS = 4
#: Vectors in a chunk where all pairs are joined, and how many chunks there are as long as they are smaller.
WIDE, FEW = 32_768, 6


def rotate(x: np.ndarray, seed: int = 5) -> np.ndarray:
    """Rows as unit vectors, rotated; only sums of two numbers at a time, so a row comes out the same in any batch."""
    x = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    width = 1 << max(2, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), width))
    y[:, : x.shape[1]] = x
    y *= np.random.default_rng(seed).choice([-1.0, 1.0], width)
    step = 1
    while step < width:
        y = y.reshape(len(x), -1, 2, step)
        y = np.concatenate([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2)
        step *= 2
    return y.reshape(len(x), width) / np.sqrt(width)


def usable(vector: list | None) -> np.ndarray | None:
    """The vector as doubles, or None if it can't link: null, empty, zero, or with a null or non-finite component."""
    if not vector or None in vector:
        return None
    x = np.asarray(vector, dtype=np.float64)
    return x if np.isfinite(x).all() and x.any() else None


def prepared(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and the vector as bytes of doubles, scaled by a power of two if its numbers are extreme; null if it can't link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = usable(v) if i is not None else None
                if x is not None:
                    x = np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])) + 0.0  # squares neither overflow nor vanish
                out.append(None if x is None else np.trim_zeros(x, "b").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "raw"])

    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, "vec_id long, raw binary")


def packed(raw: bytes) -> bytes:
    """raw as single floats, if they hold it exactly; a first byte tells which."""
    x = np.frombuffer(raw)
    short = x.astype(np.float32)
    return b"s" + short.tobytes() if (short == x).all() else b"d" + raw


def unpacked(text: bytes) -> bytes:
    return np.frombuffer(text, np.float32, offset=1).astype(np.float64).tobytes() if text[:1] == b"s" else text[1:]


def _matrix(raw: list[bytes], width: int) -> np.ndarray:
    x = np.zeros((len(raw), width))
    for i, r in enumerate(raw):
        x[i, : len(r) // 8] = np.frombuffer(r)
    return x


def pair_links(home: np.ndarray, visit: np.ndarray | None, block: int, cosine: float, tile: int = 1024, count: int = BLOCKS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (home, visit) linked by this block of count blocks first. visit None: pairs within home, each once."""
    other = home if visit is None else visit
    x, y = rotate(home), rotate(other)
    size = x.shape[1] // count
    budget = (2 - 2 * cosine) / count + 1e-9
    cut = slice(block * size, (block + 1) * size)
    xs, ys = x[:, cut].astype(np.float32), y[:, cut].astype(np.float32)
    nx, ny = (xs**2).sum(1), (ys**2).sum(1)
    for a in range(0, len(x), tile):
        for b in range(a if visit is None else 0, len(y), tile):
            near = xs[a : a + tile] @ ys[b : b + tile].T
            near *= -2
            near += nx[a : a + tile, None]
            near += ny[None, b : b + tile]
            i, j = np.nonzero(near <= budget + 1e-5)
            i, j = i + a, j + b
            if visit is None:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 1 << 15):
                p, q = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
                d = ((x[p] - y[q]) ** 2).reshape(len(p), count, size).sum(2) <= budget
                mine = d[:, block] & ~d[:, :block].any(1)
                p, q = p[mine], q[mine]
                u, v = home[p], other[q]
                cos = np.einsum("ij,ij->i", u, v) / np.sqrt(np.einsum("ij,ij->i", u, u) * np.einsum("ij,ij->i", v, v))
                yield p[cos >= cosine], q[cos >= cosine]


# ---- the tree of a block: a leaf is its number, an inner node (coordinate, cut, part up to the cut, part over it) -----


def grow(y: np.ndarray, leaves: int, first: int = 0, least: int = 16) -> tuple[tuple | int, int]:
    """A tree of about `leaves` leaves over a sample, cut at the median of the coordinate that varies most, and the
    number after its last leaf. A leaf has `least` rows of the sample at least."""
    if leaves > 1 and len(y) >= 2 * least:
        at = int(y.var(axis=0).argmax())
        cut = float(np.median(y[:, at]))
        low = y[:, at] <= cut
        if not low.all():
            left, middle = grow(y[low], -(-leaves // 2), first, least)
            right, last = grow(y[~low], leaves // 2, middle, least)
            return (at, cut, left, right), last
    return first, first + 1


def homes(tree: tuple | int, y: np.ndarray) -> np.ndarray:
    out, todo = np.zeros(len(y), dtype=np.int64), [(tree, np.arange(len(y)))]
    while todo:
        node, rows = todo.pop()
        if isinstance(node, int):
            out[rows] = node
        else:
            low = y[rows, node[0]] <= node[1]
            todo += [(node[2], rows[low]), (node[3], rows[~low])]
    return out


def visits(tree: tuple | int, y: np.ndarray, home: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and the leaves after their own that they reach: those where the cuts on the way are within the squared budget."""
    rows_out, leaves_out = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    todo = [(tree, np.arange(len(y)), np.zeros(y.shape), np.zeros(len(y)))]
    while todo:
        node, rows, gaps, total = todo.pop()
        if isinstance(node, int):
            rows = rows[home[rows] < node]
            rows_out.append(rows)
            leaves_out.append(np.full(len(rows), node))
            continue
        at, cut, left, right = node
        off = y[rows, at] - cut
        for child, gap in ((left, np.maximum(off, 0) ** 2), (right, np.maximum(-off, 0) ** 2)):
            wider = np.maximum(gaps[:, at], gap)
            reached = total + wider - gaps[:, at]
            keep = reached <= budget
            if keep.any():
                inner = gaps[keep]
                inner[:, at] = wider[keep]
                todo.append((child, rows[keep], inner, reached[keep]))
    return np.concatenate(rows_out), np.concatenate(leaves_out)


def fewer(n: int, wide: int, dealing: int) -> bool:
    """Whether all pairs of chunks of wide vectors deal fewer rows than the tree."""
    return n * -(-n // wide) < dealing


def _join(batch: pd.DataFrame, block: int, cosine: float, alone: bool, count: int = BLOCKS) -> pd.DataFrame:
    """Links between the two chunks of a task, or within the one that is alone: weight of linked vectors and the root in a
    spanning forest, by node."""
    width = max(len(r) for r in batch["raw"]) // 8
    parts = [batch[batch["side"] == s].sort_values("node") for s in (0, 1)]
    home, visit = (_matrix(p["raw"].tolist(), width) for p in parts)
    nodes = np.concatenate([p["node"].to_numpy() for p in parts])
    weight = np.concatenate([p["w"].to_numpy() for p in parts])
    links, root, shift = np.zeros(len(nodes), dtype=np.int64), np.arange(len(nodes)), 0 if alone else len(home)
    for i, j in pair_links(home, None if alone else visit, block, cosine, count=count) if alone or (len(home) and len(visit)) else ():
        j = j + shift
        np.add.at(links, i, weight[j])
        np.add.at(links, j, weight[i])
        while len(i):
            low = np.minimum(root[i], root[j])
            stale = (root[i] != low) | (root[j] != low)
            if not stale.any():
                break
            np.minimum.at(root, root[i], low)
            np.minimum.at(root, root[j], low)
            while (root[root] != root).any():
                root = root[root]
    found = links > 0
    return pd.DataFrame({"node": nodes[found], "links": links[found], "root": nodes[root[found]]})


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, chunk: int = 8192, sample: int = 50_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept. cosine must be over 0.5.

    Vectors that are null, empty or zero, or hold null or non-finite components, and rows without an id, link with
    nothing and are components of their own (component_id = vec_id). Vectors of different lengths are compared as if
    zeros followed. Rows with equal vectors link with each other, also when their ids are equal. An empty table gives no
    rows. sample bounds the vectors that the trees are cut by; all vectors are joined.
    """
    rows = common.saved(prepared(vectors, id_col, vector_col), "vectors")
    # a number for each vector, fixed when the table is written
    alike = rows.where("raw is not null").groupBy("raw").agg(F.count("*").alias("w"), F.min("vec_id").alias("first"))
    alike = common.saved(alike.withColumn("node", F.monotonically_increasing_id()), "distinct")
    spark, budget = vectors.sparkSession, (2 - 2 * cosine) / BLOCKS + 1e-9
    facts = alike.agg(F.count("*").alias("n"), F.max(F.length("raw")).alias("bytes")).first()
    n, width = facts["n"], max(1, (facts["bytes"] or 0) // 8)

    def blocks(raw: list[bytes]) -> np.ndarray:
        """(blocks, vectors, coordinates); every row is widened to the widest of all, so that no batch changes its rotation."""
        y = rotate(_matrix(raw, width))
        return y.reshape(len(raw), BLOCKS, y.shape[1] // BLOCKS).transpose(1, 0, 2)

    # which vectors the sample has is up to their hash; it is read by the driver, its size is the parameter's
    some = alike.where(F.pmod(F.xxhash64("raw"), F.lit(1 << 20)) <= int((1 << 20) * min(1.0, 0.9 * sample / max(n, 1)))).select("raw").limit(sample)
    known = blocks([bytes(r["raw"]) for r in some.collect()]) if n else np.zeros((BLOCKS, 0, 1))
    trees = [grow(y, -(-2 * n // chunk))[0] for y in known]
    shared = spark.sparkContext.broadcast(trees)  # two numbers a leaf, sample / 16 leaves at most

    def census(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for b, y in enumerate(blocks(batch.column(0).to_pylist())):
                home = homes(shared.value[b], y)
                for kind, leaves in ((0, home), (1, visits(shared.value[b], y, home, budget)[1])):
                    got, count = np.unique(leaves, return_counts=True)
                    rows += [(b, kind, leaf, c) for leaf, c in zip(got.tolist(), count.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["b", "kind", "leaf", "n"])

    counted = alike.select("raw").mapInArrow(census, "b long, kind long, leaf long, n long").groupBy("b", "kind", "leaf").agg(F.sum("n").alias("n")).collect()
    size = 1 + max((r["leaf"] for r in counted), default=0)
    parts = np.ones((BLOCKS, 2, size), dtype=np.int64)  # chunks of each leaf's own vectors and of its visitors
    parts[:, 1] = 0
    for r in counted:
        parts[r["b"], r["kind"], r["leaf"]] = -(-r["n"] // chunk)
    # rows that the tree deals: each vector to its leaf's pairs of chunks, to its visitors' chunks, and to the chunks of leaves that it visits
    dealing = sum(int(r["n"]) * int(parts[r["b"], 0, r["leaf"]] + (parts[r["b"], 1, r["leaf"]] if r["kind"] == 0 else 0)) for r in counted)
    wide = max(chunk, min(WIDE, -(-n // FEW)))
    plain = fewer(n, wide, dealing)
    if plain:
        shared, parts = spark.sparkContext.broadcast([0]), np.zeros((1, 2, 1), dtype=np.int64)
        parts[0, 0, 0] = -(-n // wide)
    count = 1 if plain else BLOCKS
    chunks = spark.sparkContext.broadcast(parts)

    def each(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every place as often as counted, and the number of each time."""
        at = np.repeat(np.arange(len(count)), count)
        return at, np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mixed = batch.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            mine, other = ((mixed >> np.uint64(s)).astype(np.int64) for s in (33, 17))
            sent = [batch.column(0), pa.array([packed(v) for v in batch.column(1).to_pylist()], pa.binary()), batch.column(2)]
            tasks = []  # columns: block, leaf, own chunk, second chunk, chunk of visitors (-1: a task of the leaf's own), side, row
            for b, y in enumerate(blocks(batch.column(1).to_pylist())[:count]):
                own, seen = chunks.value[b]
                home = homes(shared.value[b], y)
                k = mine % own[home]
                at, m = each(own[home])
                tasks.append((b, home[at], np.minimum(k[at], m), np.maximum(k[at], m), -1, (k[at] > m) * 1, at))
                at, g = each(seen[home])
                tasks.append((b, home[at], k[at], 0, g, 0, at))
                if plain:
                    continue
                row, leaf = visits(shared.value[b], y, home, budget)
                at, m = each(own[leaf])
                tasks.append((b, leaf[at], m, 0, other[row[at]] % np.maximum(seen[leaf[at]], 1), 1, row[at]))
            columns = [np.concatenate([np.broadcast_to(t[c], len(t[-1])) for t in tasks]) for c in range(7)]
            for lo in range(0, len(columns[0]), 20_000):
                *keys, at = (c[lo : lo + 20_000] for c in columns)
                take = pa.array(at.astype(np.int64))
                yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in keys), *(c.take(take) for c in sent)], names)

    names = ["b", "leaf", "k", "m", "g", "side", "node", "raw", "w"]
    dealt = alike.select("node", "raw", "w").mapInArrow(deal, "b int, leaf int, k int, m int, g int, side int, node long, raw binary, w long")

    def run(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        pad = bytes(8 * width)
        batch["raw"] = [r + pad[len(r) :] for r in map(unpacked, batch["raw"])]
        return _join(batch, int(key[0]), cosine, int(key[4]) < 0 and key[2] == key[3], count)

    found = common.saved(dealt.groupBy("b", "leaf", "k", "m", "g").applyInPandas(run, "node long, links long, root long"), "links")
    links = common.saved(found.groupBy("node").agg(F.sum("links").alias("links")), "counts")
    roots = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    named = alike.select("node", "raw", "w", "first").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = common.saved(named.groupBy("root").agg(F.min("first").alias("component")), "least")
    classes = named.join(least.hint("merge"), "root").join(links.hint("merge"), "node", "left").select("raw", F.col("component"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n"))
    out = rows.join(common.saved(classes, "classes").hint("merge"), "raw", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.9; odd input as in near_duplicates()."""
    return near_duplicates(common.load(spark, sf_dir, "embeddings"))

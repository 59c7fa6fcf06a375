"""Exact top-k by integer inner product: Fagin's threshold algorithm over sorted per-dimension lists.

Candidates are dealt to shards by hash and queries to blocks; each task holds one shard and one block. It sorts the
shard once along every dimension. A query walks the lists from the end that its sign prefers, a step at a time in all
dimensions together, scores what it meets for the first time, and stops when the sum over dimensions of query times
the list's current value is below its k-th score: nothing further down can reach it. A tie at the bound goes on, as a
smaller id may wait there. Each shard's k best are then ranked over all shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id and floor(scale * x) of every component as 64-bit integers; rows that take no part are left out.

    Inner products of vectors whose squares add up to less than 2^62 fit into 64 bits, and so do all their partial sums.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i is None or v is None or None in v:
                    continue
                x = np.floor(scale * np.asarray(v, dtype=np.float64))
                if np.isfinite(x).all() and np.dot(x, x) < 2.0**62:
                    ids.append(i)
                    out.append(x.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["id", "raw"])

    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, "id long, raw binary")


def _matrix(raw: list[bytes], width: int) -> np.ndarray:
    x = np.zeros((len(raw), width), dtype=np.int64)
    for i, r in enumerate(raw):
        x[i, : len(r) // 8] = np.frombuffer(r, dtype="<i8")
    return x


class Shard:
    """Candidates with a list for each dimension: their places in ascending order of value."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.lists = np.argsort(self.x, axis=0, kind="stable")
        self.values = np.take_along_axis(self.x, self.lists, axis=0)

    def best(self, q: np.ndarray, k: int, own: int, first_step: int = 16) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the k best candidates other than `own`: by score, then id. Also the depth, in self.depth."""
        n, dims = len(self.ids), np.flatnonzero(q)
        down = q[dims] > 0
        seen = self.ids == own
        found, scores = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        at, step = 0, first_step
        while at < n:
            to = min(n, at + step)
            if len(dims):
                met = np.concatenate([self.lists[n - to : n - at, dims[down]].ravel(), self.lists[at:to, dims[~down]].ravel()])
            else:
                met = np.arange(at, to)
            mark = np.zeros(n, dtype=bool)
            mark[met] = True
            new = np.flatnonzero(mark & ~seen)
            seen[new] = True
            found = np.concatenate([found, new])
            scores = np.concatenate([scores, self.x[new] @ q])
            keep = np.lexsort((self.ids[found], -scores))[:k]
            found, scores = found[keep], scores[keep]
            at, step = to, step * 2
            if len(dims) and len(found) == k and at < n:
                edge = np.where(down, self.values[n - at, dims], self.values[at - 1, dims]).astype(np.float64)
                # the bound is of no one vector, so it may pass 64 bits: it is taken in doubles, with what rounding can hide
                if edge @ q[dims] + 1e-12 * (np.abs(edge) @ np.abs(q[dims])) + 1 < scores[-1]:
                    break
        self.depth = at
        return self.ids[found], scores


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, shard_rows: int = 16_384, block_queries: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, its k best among all other rows.

    Rows without an id, with a null vector, or with a null or non-finite component take no part. Components are
    floor(scale * x); vectors of different lengths count as if zeros followed. A vector whose scaled components' squares
    add up to 2^62 or more takes no part either, as its scores could pass 64 bits. Ties go to the smaller id. Candidates
    that share the query's id are its own. Rows that repeat an id are candidates (and queries) each, also if their
    vectors are equal. An empty table gives no rows.
    """
    rows = common.saved(quantised(vectors, id_col, vector_col, scale).withColumn("row", F.monotonically_increasing_id()), "integers")
    size = rows.agg(F.count("*").alias("n"), F.sum((F.pmod("id", F.lit(every)) == 0).cast("long")).alias("q"), F.max(F.length("raw")).alias("w")).first()
    n_shards, n_blocks, width = -(-(size["n"] or 1) // shard_rows), -(-(size["q"] or 1) // block_queries), (size["w"] or 8) // 8
    # a stated query set against all rows, in blocks: each shard meets each block once
    # rows are dealt by their own number, so rows that repeat an id and a vector don't meet in one shard or block
    number = F.col("row")
    candidates = rows.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.pmod(number, F.lit(n_shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "id", "raw", "row")
    queries = rows.where(F.pmod("id", F.lit(every)) == 0)
    queries = queries.select(F.pmod(F.xxhash64(number), F.lit(n_blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"), F.lit(1).alias("kind"), "id", "raw", "row")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        own, asked = group[group["kind"] == 0], group[group["kind"] == 1]
        out = []
        if len(own) and len(asked):
            shard = Shard(own["id"].to_numpy(), _matrix(own["raw"].tolist(), width))
            for q, row, raw in zip(asked["id"], asked["row"], _matrix(asked["raw"].tolist(), width), strict=True):
                ids, scores = shard.best(raw, k, q)
                out.append(pd.DataFrame({"query_id": q, "row": row, "vec_id": ids, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "row": [], "vec_id": [], "score": []})

    best = candidates.unionByName(queries).groupBy("shard", "block").applyInPandas(run, "query_id long, row long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")).cast("int")
    ranked = best.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all embeddings for each whose id is divisible by 50; odd input as in top_k()."""
    return top_k(common.load(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5"""

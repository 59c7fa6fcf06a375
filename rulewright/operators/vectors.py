"""Vector retrieval: cosine top-K with filters, and for many queries at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def unit(vector: Column) -> Column:
    """The vector as doubles of length 1; null if it has none."""
    v = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def band(similarity: Column) -> Column:
    """Confidence bands of a similarity."""
    return F.when(similarity >= 0.9, "very_high").when(similarity >= 0.75, "high").when(similarity >= 0.6, "medium").when(similarity >= 0.4, "low").otherwise("none")


def top_k(vectors: DataFrame, query: list[float], k: int = 10, least: float = 0.0, where: str | None = None) -> DataFrame:
    """vec_id, similarity and band of the k nearest to one query vector, after a filter; ties go to the smaller id."""
    q = F.array(*(F.lit(float(x)) for x in np.asarray(query, dtype=float) / np.linalg.norm(query)))
    rows = (vectors.where(where) if where else vectors).select("vec_id", dot(unit(F.col("embedding")), q).alias("similarity"))
    found = rows.where(F.col("similarity") >= least).orderBy(F.desc("similarity"), "vec_id").limit(k)
    return found.select("vec_id", F.round("similarity", 6).alias("similarity"), band(F.col("similarity")).alias("band"))


def _units(rows: DataFrame) -> DataFrame:
    """vec_id, v (length 1) and row (a number for each row, by which it is dealt); rows without a direction go."""
    return rows.select("vec_id", unit(F.col("embedding")).alias("v"), F.monotonically_increasing_id().alias("row")).where("v is not null")


def _numbers(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(n.cast("long"), F.lit(1).cast("long")) - 1))


def _nearest(dealt: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The k nearest of each asked row among the dealt ones of its (shard, block), ranked over all: columns as batched_top_k().
    A task holds one shard and one block of queries, and compares them 256 queries at a time."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        own, some = group[group["kind"] == 0].sort_values("vec_id"), group[group["kind"] == 1]
        out = []
        if len(own) and len(some):
            x, ids = np.stack(own["v"].to_numpy()), own["vec_id"].to_numpy()
            for lo in range(0, len(some), 256):
                part = some.iloc[lo : lo + 256]
                s = np.stack(part["v"].to_numpy()) @ x.T
                s[part["vec_id"].to_numpy()[:, None] == ids[None, :]] = -np.inf
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                out += [pd.DataFrame({"query_id": q, "row": r, "vec_id": ids[b], "similarity": row[b]}) for q, r, b, row in zip(part["vec_id"], part["row"], best, s, strict=True)]
        got = pd.concat(out) if out else pd.DataFrame({"query_id": [], "row": [], "vec_id": [], "similarity": []})
        return got[np.isfinite(got["similarity"].astype(float))]

    columns = ["shard", "block", "kind", "vec_id", "v", "row"]
    rows = dealt.withColumn("kind", F.lit(0)).select(*columns).unionByName(asked.withColumn("kind", F.lit(1)).select(*columns))
    best = rows.groupBy("shard", "block").applyInPandas(run, "query_id long, row long, vec_id long, similarity double")
    place = F.row_number().over(Window.partitionBy("query_id", "row").orderBy(F.desc(F.round("similarity", 9)), "vec_id")).cast("int")
    return best.withColumn("place", place).where(F.col("place") <= k).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "place")


def batched_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = 20_000, block_queries: int = 20_000) -> DataFrame:
    """query_id, vec_id, similarity, place: the k nearest of each query among all vectors of another id, exactly.

    Vectors are dealt to shards and queries to blocks; each shard meets each block once and keeps k for each query, so a
    task holds a shard and a block whatever the sizes of both tables. Rows that repeat an id are each asked and each found.
    """
    known, some = _units(vectors), _units(queries)
    n_shards, n_blocks = -(-known.count() // shard_rows), -(-some.count() // block_queries)
    dealt = known.select("*", F.pmod("row", F.lit(max(n_shards, 1))).alias("shard"), _numbers(F.lit(n_blocks)).alias("block"))
    asked = some.select("*", F.pmod("row", F.lit(max(n_blocks, 1))).alias("block"), _numbers(F.lit(n_shards)).alias("shard"))
    return _nearest(dealt, asked, k)


def fit_centres(vectors: DataFrame, n_lists: int, sample: int = 20_000, rounds: int = 8) -> np.ndarray:
    """Directions that vectors gather around: k-means on about `sample` rows by hash of the id. Only the centres rest on
    the sample; every row is indexed."""
    known = _units(vectors)
    step = max(1, known.count() // sample)
    rows = known.where(F.pmod(F.xxhash64("vec_id"), F.lit(step)) == 0).orderBy("vec_id", "row").select("v").toPandas()["v"]
    if not len(rows):
        return np.zeros((0, 0))
    x = np.stack(rows.to_numpy())
    centres = x[np.linspace(0, len(x) - 1, min(n_lists, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        for c in np.unique(own):
            total = x[own == c].sum(axis=0)
            if (size := np.linalg.norm(total)) > 0:
                centres[c] = total / size
    return centres


def approximate_top_k(vectors: DataFrame, queries: DataFrame, centres: np.ndarray, probes: int, k: int = 10, shard_rows: int = 20_000, block_queries: int = 20_000) -> DataFrame:
    """Like batched_top_k(), among the vectors of the `probes` lists nearest to each query; a vector is in the list of its nearest
    centre. Long lists and lists with many queries are dealt over several tasks; a count for each list comes to the driver."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(centres)

    def lists(n: int) -> Column:
        @F.pandas_udf("array<int>")
        def nearest(v: pd.Series) -> pd.Series:
            return pd.Series(list(np.argsort(-(np.stack(v.to_numpy()) @ shared.value.T), axis=1, kind="stable")[:, :n].astype(np.int32))) if len(v) else pd.Series([], dtype=object)

        return nearest("v")

    if not len(centres):
        return batched_top_k(vectors, queries, k, shard_rows, block_queries)
    held = _units(vectors).withColumn("list", F.explode(lists(1)))
    probed = _units(queries).withColumn("list", F.explode(lists(min(probes, len(centres)))))
    sizes = {r["list"]: r["count"] for r in held.groupBy("list").count().collect()}
    asked_of = {r["list"]: r["count"] for r in probed.groupBy("list").count().collect()}
    plan = spark.createDataFrame([(c, -(-n // shard_rows), -(-asked_of.get(c, 0) // block_queries)) for c, n in sizes.items()] or [(0, 0, 0)], "list int, shards int, blocks int")
    held, probed = (x.join(F.broadcast(plan), "list").where("shards > 0 and blocks > 0") for x in (held, probed))
    name = lambda part: F.col("list").cast("long") * (1 << 32) + part
    dealt = held.select("vec_id", "v", "row", name(F.pmod("row", F.col("shards"))).alias("shard"), _numbers(F.col("blocks")).alias("block"))
    asked = probed.select("vec_id", "v", "row", "list", F.pmod("row", F.col("blocks")).alias("block"), _numbers(F.col("shards")).alias("part")).withColumn("shard", name(F.col("part")))
    return _nearest(dealt, asked, k)


def merged_candidates(retrieved: DataFrame, pack: DataFrame, k: int = 10) -> DataFrame:
    """Per query the k most similar of retrieved and pack candidates; a candidate in both counts once, as pack."""
    both = pack.select("query_id", "vec_id", "similarity", F.lit("pack").alias("origin")).unionByName(retrieved.join(pack, ["query_id", "vec_id"], "left_anti").select("query_id", "vec_id", "similarity", F.lit("stored").alias("origin")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")).cast("int")
    return both.withColumn("place", place).where(F.col("place") <= k)


def sim_03_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    query = vectors.where("vec_id = 0").select("embedding").first()
    return top_k(vectors, query[0] if query else [1.0], where="vec_id > 0 and label <> 3")


def sim_04_batched_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return batched_top_k(vectors, vectors.where("vec_id % 20 = 0"))


def sim_04_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest by an index of about sqrt(n) lists. These vectors have no clusters, so three lists of five are probed."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    n_lists = max(1, int(vectors.count() ** 0.5))
    return approximate_top_k(vectors, vectors.where("vec_id % 20 = 0"), fit_centres(vectors, n_lists), -(-3 * n_lists // 5))


def sim_05_merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    queries = vectors.where("vec_id % 20 = 0")
    return merged_candidates(batched_top_k(vectors, queries), batched_top_k(vectors.where("label = 1"), queries))


_COSINE = """SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS s FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id"""
_RANKED = "SELECT query_id, vec_id, round(s, 6) AS similarity, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS INTEGER) AS place FROM ({0}) c) r WHERE place <= 10"
ORACLES = {
    "sim_03_top_k": "SELECT vec_id, round(s, 6) AS similarity, CASE WHEN s >= 0.9 THEN 'very_high' WHEN s >= 0.75 THEN 'high' WHEN s >= 0.6 THEN 'medium' WHEN s >= 0.4 THEN 'low' ELSE 'none' END AS band FROM (SELECT v.vec_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS s FROM embeddings q JOIN embeddings v ON q.vec_id = 0 AND v.vec_id > 0 AND v.label <> 3) c WHERE s >= 0 ORDER BY s DESC, vec_id LIMIT 10",
    "sim_04_batched_top_k": _RANKED.format(_COSINE),
    "sim_05_merge_candidates": f"WITH a AS ({_RANKED.format(_COSINE)}), p AS ({_RANKED.format(_COSINE + ' AND v.label = 1')}) SELECT query_id, vec_id, similarity, origin, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS INTEGER) AS place FROM (SELECT query_id, vec_id, similarity, 'pack' AS origin FROM p UNION ALL SELECT query_id, vec_id, similarity, 'stored' FROM a WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.query_id = a.query_id AND p.vec_id = a.vec_id)) u) r WHERE place <= 10",
}
QUERIES = {"sim_03_top_k": sim_03_top_k, "sim_04_batched_top_k": sim_04_batched_top_k, "sim_04_approximate": sim_04_approximate, "sim_05_merge_candidates": sim_05_merge_candidates}

import duckdb
import numpy as np
import pytest

from rulewright.llm import topk


def brute(rows, k, every):
    ok = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all()]
    width = max(len(v) for _, v in ok)
    ok = [(i, np.pad(v, (0, width - len(v)))) for i, v in ok]
    out = []
    for q, x in ok:
        if q % every == 0:
            best = sorted((-int(x @ y), i) for i, y in ok if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("shard,block", [(16_384, 512), (30, 4)])
def test_same_as_all_pairs(spark, shard, block):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(150, 16)) / 4
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(200 + i, base[0].tolist()) for i in range(120)] + [(i, base[i - 500].tolist()) for i in range(500, 520)]
    rows += [(1000, None), (1050, [None]), (1100, [float("nan")] * 16), (1150, [float("inf")]), (None, base[0].tolist()), (1200, []), (1250, [0.0] * 16), (1300, [1.0]), (-50, [-1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, rank int, raw string").repartition(3)
    got = sorted(tuple(r) for r in topk.top_k(df, shard_rows=shard, block_queries=block).collect())
    assert got == brute(rows, 5, 50)


def test_fewer_than_k_and_nothing(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.top_k(df.where("false")).count() == 0


def test_repeated_queries_and_numbers_beyond_64_bits(spark):
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.0])] + [(i, [i / 256, 0.0]) for i in range(1, 9)] + [(60, [1e18, 1.0]), (61, [3e6, 3e6]), (100, [-3e6, 3e6])]
    got = sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    one = [(50, 1, 61, 768000000 * 256), *((50, r, i, 256 * i) for r, i in zip(range(2, 6), (8, 7, 6, 5)))]
    assert got[:10] == sorted(one * 2) and got[10][:3] == (100, 1, 61) and all(g[0] == 100 for g in got[10:])


def test_it_stops_before_the_end():
    rng = np.random.default_rng(0)
    x = rng.integers(-3, 4, size=(5000, 8))
    x[:10] = 200
    shard = topk.Shard(np.arange(5000), x)
    shard.best(np.full(8, 100), 5, -1)
    assert shard.depth < 100


def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = sorted(con.sql(topk.ORACLE_SQL).fetchall())
    assert sorted(tuple(r) for r in topk.op9_exact_top_k(spark, sf).collect()) == want

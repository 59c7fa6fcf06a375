import numpy as np
import pytest

from rulewright.llm import embeddings, graph


def brute(rows, cosine):
    n = len(rows)
    usable = [i is not None and v is not None and len(v) > 0 and None not in v and np.isfinite(np.array(v, float)).all() and any(v) for i, v in rows]
    width = max([len(v) for _, v in rows if v] or [1])
    x = np.array([(list(v) + [0.0] * (width - len(v))) if ok else [0.0] * width for (_, v), ok in zip(rows, usable)], float)
    norm = np.linalg.norm(x, axis=1)
    with np.errstate(all="ignore"):
        near = (x @ x.T) / np.outer(norm, norm) >= cosine
    near &= np.outer(usable, usable)
    np.fill_diagonal(near, False)
    label = list(range(n))
    for _ in range(n):
        new = [min([label[i], *(label[j] for j in np.flatnonzero(near[i]))]) for i in range(n)]
        if new == label:
            break
        label = new
    first = {}
    for (i, _), c in zip(rows, label):
        first[c] = min(x for x in (first.get(c), i) if x is not None) if first.get(c) is not None or i is not None else None
    return sorted(((i, int(near[k].sum()), first[label[k]], i is not None and i == first[label[k]]) for k, (i, _) in enumerate(rows)), key=str)


def data():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 64))
    vectors = [b + rng.normal(size=64) * s for b in base for s in (0, 0.1, 0.2, 0.3, 0.45, 0.5)] + [base[0]] * 30 + [base[0] * 3, base[1] * 1e-30]
    rows = [(i * 3 % 1000, np.float32(v).tolist()) for i, v in enumerate(vectors)]
    return rows + [(2000, None), (2001, []), (2002, [0.0] * 64), (2003, [1.0, None]), (2004, [float("nan")] * 64), (2005, [1.0, float("inf")]), (None, base[0].tolist()), (5, base[2].tolist()), (5, base[3].tolist()), (2006, [1.0]), (2007, [2.0]), (2008, [-1.0, 0.0])]


@pytest.mark.parametrize("cosine,chunk", [(0.9, 20), (0.9, 8192), (0.8, 50)])
def test_same_as_all_pairs(spark, cosine, chunk):
    rows = data()
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, raw string").repartition(3)
    got = sorted((tuple(r) for r in embeddings.near_duplicates(df, cosine, chunk).collect()), key=str)
    assert got == brute(rows, cosine)


def test_nothing(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_a_vector_meets_every_leaf_in_its_range():
    rng = np.random.default_rng(1)
    y = rng.normal(size=(600, 16)) / 8
    tree, n = embeddings.grow(y, 16)
    home = embeddings.homes(tree, y)
    assert n == 16 and set(home) == set(range(16))
    rows, leaves = embeddings.visits(tree, y, home, 0.05)
    met = set(zip(rows.tolist(), leaves.tolist()))
    near = ((y[:, None] - y[None]) ** 2).sum(2) <= 0.05
    assert all((i, home[j]) in met for i, j in np.argwhere(near) if home[j] > home[i]) and all(leaf > home[row] for row, leaf in met)


def visits_each(n, rng):
    """Visits a vector of clustered ones makes, with leaves of about 250."""
    centres = rng.normal(size=(max(2, n // 250), 16)) / 8
    y = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, 16)) / 200
    tree, _ = embeddings.grow(y[:: max(1, n // 20_000)], -(-n // 250))
    return len(embeddings.visits(tree, y, embeddings.homes(tree, y), 0.0025)[0]) / n


def test_visits_grow_slower_than_the_table():
    rng = np.random.default_rng(2)
    small, large = visits_each(4000, rng), visits_each(40_000, rng)
    print("visits a vector", small, large)
    assert large < 4 * small


def test_rotation_keeps_distances():
    x = np.random.default_rng(0).normal(size=(20, 50))
    y, u = embeddings.rotate(x), x / np.linalg.norm(x, axis=1)[:, None]
    assert np.allclose(y @ y.T, u @ u.T) and (embeddings.rotate(x[3:5]) == y[3:5]).all()


def test_query_matches_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted((tuple(r) for r in embeddings.op3_embedding_near_dedup(spark, sf).collect()), key=str) == brute(rows, 0.9)


@pytest.mark.parametrize("links", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(1, i) for i in range(2, 50)] + [(100, 101), (101, 102), (50, 100)], [(9, 3), (3, 9), (5, 9), (7, 8)]])
def test_components(spark, links):
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = {x: x for link in links if link[0] != link[1] for x in link}
    for _ in want:
        for u, v in links:
            if u != v:
                want[u] = want[v] = min(want[u], want[v])
    assert got == want

"""Vectors without structure are dealt for all pairs of large chunks, with the same links as by the tree."""

import numpy as np
import pytest
from test_embeddings import brute, data

from rulewright.llm import embeddings


@pytest.mark.parametrize("plain", [True, False])
def test_both_ways_give_all_links(spark, monkeypatch, plain):
    monkeypatch.setattr(embeddings, "fewer", lambda n, wide, dealing: plain)
    rows = data()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted((tuple(r) for r in embeddings.near_duplicates(df, 0.9, 50).collect()), key=str) == brute(rows, 0.9)


def test_unlike_vectors_are_not_dealt_to_most_leaves(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(embeddings, "fewer", lambda *a, real=embeddings.fewer: asked.append((*a, real(*a))) or asked[-1][-1])
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(1500, 64)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted((tuple(r) for r in embeddings.near_duplicates(df, 0.9, 100).collect()), key=str) == brute(rows, 0.9)
    ((n, wide, dealing, plain),) = asked
    assert plain and n == 1500 and 6 * n < dealing / 4


def test_packed_vectors_come_back():
    for x in (np.float32([0.1, -2.5, 0]).astype(float), np.array([0.1, 1e-300])):
        assert embeddings.unpacked(embeddings.packed(x.tobytes())) == x.tobytes()
    assert len(embeddings.packed(np.ones(64).tobytes())) == 257

import random

import numpy as np
import pytest

from rulewright.llm import neardup

RNG = random.Random(3)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(3000)]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def edited(text, n):
    w = text.split()
    for _ in range(n):
        w[RNG.randrange(len(w))] = RNG.choice(WORDS)
    return " ".join(w)


def bag(text):
    w = (text or "").lower().split()
    out = {}
    for i in range(max(1, len(w) - 4) if w else 0):
        s = tuple(w[i : i + 5])
        out[s] = out.get(s, 0) + 1
    return out


def jaccard(a, b):
    least = sum(min(n, b.get(s, 0)) for s, n in a.items())
    return least / (sum(a.values()) + sum(b.values()) - least) if a and b else 0


def brute(rows):
    bags = [bag(t) for _, t in rows]
    label = list(range(len(rows)))
    near = [[j for j in range(len(rows)) if j != i and rows[i][0] is not None and rows[j][0] is not None and jaccard(bags[i], bags[j]) >= 0.8] for i in range(len(rows))]
    while True:
        new = [min([label[i], *(label[j] for j in near[i])]) for i in range(len(rows))]
        if new == label:
            break
        label = new
    first = {}
    for (i, _), c in zip(rows, label):
        if i is not None:
            first[c] = min(first.get(c, i), i)
    return sorted(((i, first.get(c), i is None or i == first.get(c)) for (i, _), c in zip(rows, label)), key=str)


def test_shingles_are_bags_of_five_words():
    texts = ["a b c d e f a b c d e", "A  b\nc\td E f", "one two", "", None, "  ", "é ü ö ä ß x " * 30, "w " * 100]
    for t in texts:
        items, counts = neardup.shingles(t)
        assert sorted(counts) == sorted(bag(t).values()) and len(items) == len(bag(t))
    for s in texts:
        for t in texts:
            assert neardup.similarity(neardup.shingles(s), neardup.shingles(t)) == pytest.approx(jaccard(bag(s), bag(t)))
    long = prose(5000)
    assert (neardup.word_hashes(long, 64) == neardup.word_hashes(long)).all() and len(neardup.word_hashes("x" * 300, 64)) == 1


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_collisions_estimate_weighted_similarity(share):
    rng = np.random.default_rng(1)
    got, want = [], []
    for _ in range(30):
        items = rng.integers(0, 2**63, 300, dtype=np.uint64)
        wa, wb = rng.uniform(0.1, 4, 300), rng.uniform(0.1, 4, 300)
        wb = np.where(rng.random(300) < share, wa, wb)
        a, b = neardup.dart_signature(items, wa), neardup.dart_signature(items, wb)
        got.append((a == b).mean())
        want.append(np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum())
    assert np.mean(got) == pytest.approx(np.mean(want), abs=0.02)


def test_signatures_of_tiny_and_large_bags():
    for n in (1, 2, 100_000):
        sig = neardup.dart_signature(np.arange(1, n + 1, dtype=np.uint64), np.ones(n))
        assert len(sig) == neardup.COORDINATES and (sig > 0).all()


def corpus():
    rows = []
    for k in range(30):
        base = prose(150)
        rows += [base, edited(base, 1), edited(base, 3), edited(base, 12), base.upper()]
    chain = [prose(200)]
    for _ in range(60):
        chain.append(edited(chain[-1], 2))
    rows += chain + [rows[0]] * 20 + ["short text", "short text", "Short  text", "short texts", "", None, " ", "same five words right here " * 200, "same five words right here " * 201]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(rows)]
    return rows + [(None, rows[0][1]), (None, None), (3, "again and again"), (3, "again and again"), (3, "another text")]


def test_same_as_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, size int").repartition(3)
    want = brute(rows)
    for chunk in (512, 20):
        got = sorted(((r.doc_id, r.class_id, r.kept) for r in neardup.near_duplicates(df, chunk_rows=chunk).collect()), key=str)
        assert got == want
    kept = [(r.doc_id, r.text, r.node) for r in neardup.deduplicate(df).collect()]
    singles = [w for w in want if w[2]]
    assert len(kept) == len(singles) - 1 and all(k[2] == "x" for k in kept)  # the repeated row stays once


def test_white_space_is_no_word(spark):
    df = spark.createDataFrame([(1, "\n"), (2, "\n"), (3, "\t \r"), (4, None), (5, ""), (6, " a\n"), (7, " a\n")], "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.kept) for r in neardup.near_duplicates(df).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (3, True), 4: (4, True), 5: (5, True), 6: (6, True), 7: (6, False)}
    assert sorted(r.doc_id for r in neardup.deduplicate(df).collect()) == [1, 2, 3, 4, 5, 6]


def test_many_bags_together_are_as_each_alone():
    texts = [prose(n) for n in (1, 2, 4, 5, 6, 300)] + ["", None, "same same same same same same", "É é " * 9]
    owner, items, counts = neardup.bags(texts)
    for i, t in enumerate(texts):
        h, n = neardup.shingles(t)
        assert (items[owner == i] == h).all() and (counts[owner == i] == n).all()
    some = [i for i, t in enumerate(texts) if t]
    together = neardup.dart_signatures(items, counts, np.searchsorted(some, owner), len(some))
    for place, i in enumerate(some):
        assert (together[place] == neardup.dart_signature(*neardup.shingles(texts[i]))).all()


def test_every_pair_is_compared_without_slack(spark):
    rows = corpus()[:100]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted(((r.doc_id, r.class_id, r.kept) for r in neardup.near_duplicates(df, slack=None).collect()), key=str)
    assert got == brute(rows)


def test_recall_of_planted_pairs():
    """Pairs of similarity 0.8 to 0.9 that share a band and pass the pre-check."""
    caught = n = 0
    while n < 300:
        base = prose(300)
        other = edited(base, RNG.randint(4, 9))
        if 0.8 <= jaccard(bag(base), bag(other)) <= 0.9:
            a, b = (neardup.dart_signature(*neardup.shingles(t)) for t in (base, other))
            same = a == b
            caught += bool(same.reshape(neardup.BANDS, neardup.ROWS).all(axis=1).any()) and same.sum() >= neardup.COORDINATES * 0.68
            n += 1
    print("caught", caught, "of", n)
    assert caught >= 0.99 * n


def test_nothing(spark):
    assert neardup.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_matches_brute_force_classes(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in neardup.op2_dart_minhash(spark, sf).collect()), key=str) == brute(rows)

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from rulewright.llm import katz


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def held_out(i):
    return i is None or zlib.crc32(str(i).encode()) % 7 == 2


class Brute:
    def __init__(self, texts, order=2):
        train = [tokens(t) for t in texts]
        self.order = order
        self.one = Counter(w for t in train for w in t)
        self.n, self.v = sum(self.one.values()), len(self.one)
        self.grams, self.next, self.d = {}, {}, {}
        for k in range(2, order + 1):
            self.grams[k] = Counter(g for t in train for g in zip(*((["<s>"] * (k - 1) + t)[j:] for j in range(k)), strict=False))
            for g, c in self.grams[k].items():
                self.next.setdefault(g[:-1], {})[g[-1]] = c
            n = Counter(self.grams[k].values())
            self.d[k] = katz.discounts(np.array([n[r] for r in range(katz.MAX_R + 2)], float))

    def p(self, h, w):
        if not h:
            return (self.one[w] + 1) / (self.n + self.v + 1)
        seen = self.next.get(h)
        if not seen:
            return self.p(h[1:], w)
        d = self.d[len(h) + 1]
        below = sum(seen.values()) + (not any(c <= katz.MAX_R for c in seen.values()))
        if w in seen:
            return (d[seen[w]] if seen[w] <= katz.MAX_R else 1) * seen[w] / below
        part = sum((d[c] if c <= katz.MAX_R else 1) * c / below for c in seen.values())
        return (1 - part) / (1 - sum(self.p(h[1:], x) for x in seen)) * self.p(h[1:], w)

    def row(self, i, text, held):
        t, k = tokens(text), self.order - 1
        padded = ["<s>"] * k + t
        score = sum(math.log10(self.p(tuple(padded[j : j + k]), t[j])) for j in range(len(t)))
        return [i, held, len(t), sum(self.one[w] > 0 for w in t), self.n, sum(math.log10(self.p((), w)) for w in t), score]


def corpus():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 4))) for _ in range(120)]
    rows = [(i, " ".join(rng.choice(vocabulary[: rng.choice([3, 20, 120])]) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    return rows + [(200, None), (201, ""), (202, " \t\n"), (203, "A\x1cB É é x"), (None, "a b c"), (None, None), (5, rows[5][1]), (5, rows[5][1]), (204, "zz " * 5000)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1.5) for r in rows], "doc_id long, text string, word string, score double").repartition(3)


def ordered(rows):
    return sorted(rows, key=lambda r: (str(r[0]), r[2], r[6]))


def same(got, want):
    got, want = ordered([list(r) for r in got]), ordered(want)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want])


@pytest.mark.parametrize("order,chunk,bucket", [(2, 20 << 20, 1_000_000), (2, 500, 300), (2, 50, 5000), (3, 20 << 20, 1_000_000), (3, 2000, 500), (4, 3000, 2000)])
def test_same_as_plain_counts(spark, tmp_path, order, chunk, bucket):
    rows = corpus()
    model = Brute([t for i, t in rows if not held_out(i)], order)
    got = katz.train_and_score(frame(spark, rows), f"file://{tmp_path}/m", order=order, chunk_bytes=chunk, bucket_tokens=bucket).collect()
    same(got, [model.row(i, t, held_out(i)) for i, t in rows])


@pytest.mark.parametrize("order", [2, 3])
def test_a_saved_model_scores_another_table(spark, tmp_path, order):
    rows = corpus()
    katz.train(frame(spark, rows[:100]), f"file://{tmp_path}/m", order=order, bucket_tokens=400, chunk_bytes=3000)
    got = katz.score(frame(spark, rows[100:]), katz.load(spark, f"file://{tmp_path}/m")).collect()
    model = Brute([t for _, t in rows[:100]], order)
    same(got, [model.row(i, t, True) for i, t in rows[100:]])
    assert katz.score(frame(spark, rows[:0]), katz.load(spark, f"file://{tmp_path}/m")).count() == 0


def test_the_model_is_normalised():
    model = Brute([t for _, t in corpus()], 3)
    everything = [*model.one, "never seen"]
    for h in [("<s>",), ("<s>", "<s>"), *list(model.next)[:20], *list(model.next)[-20:]]:
        assert sum(model.p(h, w) for w in everything) == pytest.approx(1)


def test_nothing_and_no_training(spark, tmp_path):
    assert katz.train_and_score(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/a").count() == 0
    r = katz.train_and_score(spark.createDataFrame([(None, "a b")], "doc_id long, text string"), f"file://{tmp_path}/b").first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0.0, 0.0)
    with pytest.raises(ValueError):
        katz.train(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), f"file://{tmp_path}/c", order=1)


def test_query_beats_its_base(spark, sf):
    rows = katz.op7_katz_backoff(spark, sf).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    model = Brute([t for i, t in docs if not held_out(i)])
    assert len({r.doc_id for r in rows}) == len(rows) == len(docs) and {r.train_tokens for r in rows} == {model.n}
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)

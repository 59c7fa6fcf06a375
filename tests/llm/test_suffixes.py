import hashlib

import numpy as np
import pytest
from rulewright.llm import suffixes


def brute(rows, length):
    """(id, bytes, removed, spans, hash) of texts in order of id, by a set of all strings of `length` bytes."""
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        b = (text or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = [True] * length
            seen.add(b[p : p + length])
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), len(b) - len(kept), sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


def texts(seed, n, letters, most):
    """Invented texts of few letters, with passages taken from each other, repeats of short periods and other scripts."""
    rng = np.random.default_rng(seed)
    passages = ["".join(rng.choice(list(letters), rng.integers(5, most))) for _ in range(8)]
    out = []
    for i in range(n):
        parts = [passages[j] for j in rng.integers(0, 8, rng.integers(0, 4))] + ["".join(rng.choice(list(letters), rng.integers(0, most))), "xy" * int(rng.integers(0, most // 2)), "é漢" * int(rng.integers(0, 3))]
        rng.shuffle(parts)
        out.append((int(i * 7 % n) - 3, "".join(parts)))
    return out


@pytest.mark.parametrize("length,chunk,ranges,hot", [(100, 4 << 20, 200_000, 200_000), (20, 2000, 50, 10**6), (20, 500, 1000, 3), (7, 300, 40, 20), (2, 200, 100, 5), (130, 3000, 60, 40), (64, 1500, 64, 2)])
def test_same_as_a_set_of_all_strings(spark, length, chunk, ranges, hot):
    rows = texts(length, 90, "abcdefgh ", 4 * length + 20)
    rows += [(500, None), (501, ""), (502, "a" * (3 * length)), (503, "\0" * (2 * length)), (504, rows[3][1]), (505, rows[3][1][1:]), (506, "ab" * 2000), (None, rows[5][1])]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, blob string, chunk int").repartition(3)
    got = suffixes.repeats(df, length, chunk_bytes=chunk, range_anchors=ranges, hot_anchors=hot, bucket_anchors=300, sample=500)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows, length)


def test_spans_kept_text_repeated_rows_and_nothing(spark):
    passage = "the same passage of more than twenty bytes "
    rows = [(1, "first " + passage), (2, passage + "second"), (2, passage + "second"), (3, "third")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in suffixes.repeats(df, 20, with_text=True).collect())
    assert [(r[0], [tuple(s) for s in r[5]], bytes(r[6]).decode()) for r in got if r[0] != 2] == [(1, [], rows[0][1]), (3, [], "third")]
    assert sorted(bytes(r[6]).decode() for r in got if r[0] == 2) == ["", "second"]
    assert suffixes.repeats(df.where("false")).count() == 0
    assert [tuple(r)[:4] for r in suffixes.repeats(df.where("doc_id = 3")).collect()] == [(3, 5, 0, 0)]


def test_multikey_order_and_common_prefixes():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, size=(400, 21)).astype(np.uint8)
    tokens = suffixes._tokens(x)
    order = suffixes.multikey_sort(tokens)
    assert [x[i].tobytes() for i in order] == sorted(r.tobytes() for r in x)
    lcp = suffixes.common_prefixes(tokens, order, 21)
    for j in range(1, 400):
        a, b = x[order[j - 1]], x[order[j]]
        assert lcp[j] == (21 if (a == b).all() else int((a != b).argmax()))


def test_a_long_text_of_one_letter_stays_small(spark):
    got = suffixes.repeats(spark.createDataFrame([(1, "a" * 3_000_000), (2, "b" * 10)], "doc_id long, text string")).collect()
    assert sorted(tuple(r)[:4] for r in got) == [(1, 3_000_000, 2_999_999, 1), (2, 10, 0, 0)]


def test_query_on_all_documents(spark, sf):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(str(tuple(r)) for r in suffixes.op11_suffix_array_dedup(spark, sf).collect()) == brute(rows, 100)

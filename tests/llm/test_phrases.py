import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from rulewright.llm import phrases


def brute(rows, least, longest, top):
    """Rows of the result from (lang, text) by plain counting."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    f, total = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found, n = [], total[lang]
        ok = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        inside = {(g[i : i + k], a) for g, a in ok.items() for k in range(2, len(g)) for i in range(len(g) - k + 1)}
        for g, a in ok.items():
            if (g, a) not in inside:
                s, _, l, r = min((1000 * a * n // (counts[g[:k]] * counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g)))
                found.append((-s, -a, " ".join(g).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("least,chunk,bucket,tile", [(3, 8 << 20, 10**6, 1024), (3, 150, 40, 2), (2, 400, 7, 4), (6, 1000, 10**6, 3)])
def test_same_as_plain_counts(spark, least, chunk, bucket, tile):
    rng = np.random.default_rng(5)
    words = ["the", "The", "of", "é", "漢字", "a", "new", "york", "x1", "\x01", "don't", "São"]
    seps = [" ", "  ", "\t", ". ", ",", "\n", "\x0b", "! "]
    text = lambda: "".join(words[min(int(rng.exponential(3)), 11)] + seps[min(int(rng.exponential(1.2)), 7)] for _ in range(int(rng.integers(0, 60))))
    rows = [(["en", "en", "fr", None, "und"][int(rng.integers(0, 5))], text()) for _ in range(60)]
    rows += [("en", None), ("en", ""), ("de", "one two three four five six " * 40), ("fr", "New York new york. " * 30), ("fr", "New York new york. " * 30)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "lang string, text string, n int, word string, chunk int").repartition(3)
    got = phrases.collocations(df, least, chunk_bytes=chunk, bucket_pairs=bucket, tile=tile, bucket_bytes=3000, top=25)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, least, 5, 25)


def test_other_lengths_and_nothing(spark):
    rows = [("en", "a b c d a b c d a b")]
    df = spark.createDataFrame(rows, "lang string, text string")
    for longest in (2, 3, 7):
        assert sorted(tuple(r) for r in phrases.collocations(df, 2, longest).collect()) == brute(rows, 2, longest, 2000)
    assert phrases.collocations(df).count() == 0 and phrases.collocations(df.where("false")).count() == 0


def test_products_beyond_64_bits(spark):
    level = spark.createDataFrame([(3 * 10**14, 5 * 10**15)], "c long, n long")
    got = level.selectExpr("(CAST(1000 AS DECIMAL(38,0)) * CAST(c AS DECIMAL(38,0)) * CAST(n AS DECIMAL(38,0))) div (CAST(c AS DECIMAL(38,0)) * CAST(c + 1 AS DECIMAL(38,0))) AS s").first()[0]
    assert got == 1000 * 5 * 10**15 // (3 * 10**14 + 1)


def test_tiles_dense_and_sparse():
    rng = np.random.default_rng(3)
    a, b = np.minimum(rng.geometric(0.2, 5000), 60), np.minimum(rng.geometric(0.1, 5000), 90)
    n = rng.integers(1, 5, 5000)
    want = Counter()
    for x, y, k in zip(a.tolist(), b.tolist(), n.tolist()):
        want[x, y] += k
    for tile in (4, 16, 1024):
        p, q, c, place = phrases.tile_counts(a, b, n, tile)
        assert dict(zip(zip(p.tolist(), q.tolist()), c.tolist())) == dict(want) and len(p) == len(want)
        assert (p[place] == a).all() and (q[place] == b).all()


def test_words_and_runs():
    words, ids = phrases.words_of(b"a b\nc a  d\n\n")
    assert words.cast(pa.string()).to_pylist() == ["a", "b", "c", "d"] and ids.tolist() == [1, 2, 0, 3, 1, 4]
    assert phrases.kept_runs(np.array([5, 0, 1, 2, 0, 0, 3, 0, 4, 4])).tolist() == [1, 2, 0, 4, 4]


def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    got = phrases.op12_phrase_collocations(spark, sf)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and {t for c, t in got.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    assert sorted(tuple(r) for r in got.collect()) == sorted(con.sql(phrases.oracle_sql()).fetchall())

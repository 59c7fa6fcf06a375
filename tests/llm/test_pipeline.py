import hashlib
import re
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import pandas as pd
from rulewright.llm import mixing, packing, pii, tokens

from test_neardup import brute
from test_tokens import whole


def test_each_stage_on_what_the_one_before_kept(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en", "src0", 0), (10**6 + 1, "12 !!", "en", "src1", 5), (10**6 + 2, "", None, None, 0), (None, "the and of the", "en", "src1", 14), (10**6 + 3, "это совсем другой язык и никто его не учил здесь", "en", "src1", 46)], docs.schema)
    docs = docs.unionByName(extra)
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.common.saved(stage(spark, docs, sf), name)
        assert docs.columns == columns
        seen[name] = ([tuple(r) for r in before.collect()], [tuple(r) for r in docs.collect()])
    before, after = seen["language_id"]
    assert sorted(map(str, after)) == sorted(str(r) for r in before if r[1] and re.search(r"[^\W\d_]", r[1]) and r[0] != 10**6 + 3)
    before, after = seen["near_dedup"]
    kept = {i for i, _, k in brute([(r[0], r[1]) for r in before]) if k}
    assert sorted(map(str, after)) == sorted(str(r) for r in before if r[0] in kept)
    before, after = seen["personal_data"]
    texts, weights = {r[0]: r[1] for r in after}, pii.train()
    assert len(after) == len(before)
    for r in before:
        spans, out, at = pii.base_spans(r[1]), texts[r[0]], 0
        if not pii.all_spans(r[1], weights):
            assert out == r[1] or spans
        assert not any(r[1][s:e] in out for k, s, e in spans if k != 1)
    before, after = seen["mixture"]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([r for r in before if r[0] is not None], columns=docs.columns).astype({"doc_id": "int64"}))
    if all(r[0] is not None for r in before):
        want = con.sql(mixing.oracle_sql(part=(4, 5), max_epochs=1)).df()
        assert sorted(r[0] for r in after) == sorted(want["doc_id"])
    else:
        again = mixing.mix(spark.createDataFrame(before, docs.schema), part=(4, 5), max_epochs=1).collect()
        assert sorted(str(r[0]) for r in after) == sorted(str(r.doc_id) for r in again)
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    ids = [np.array([*x, tokens.END_ID], dtype="<u4") for x in whole([r[1] for r in after])]
    assert sorted(r.length for r in rows) == sorted(n for x in ids for n in packing.piece_lengths(len(x)))
    pieces = {}
    for r in sorted(rows, key=lambda r: r.start):
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    for r, x in zip(after, ids, strict=True):
        if sum(a[0] == r[0] for a in after) == 1:
            assert [(a, n, zlib.crc32(x[a : a + n].tobytes())) for a, n, _ in pieces[r[0]]] == pieces[r[0]]
    assert {r.doc_id for r in rows} == {r[0] for r in after}


def test_mixture_is_that_of_the_plain_sql(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    got = corpus_pipeline.mixture(spark, docs, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(x for (x,) in con.sql(f"select doc_id from ({mixing.oracle_sql(part=(4, 5), max_epochs=1)})").fetchall())


def test_stages_of_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0, name


def test_run_gives_the_same_rows_twice(spark, sf):
    digest = lambda: hashlib.md5(str(sorted((r.doc_id or -1, r.start, r.ids_crc32) for r in corpus_pipeline.run(spark, sf).collect())).encode()).hexdigest()
    assert digest() == digest()

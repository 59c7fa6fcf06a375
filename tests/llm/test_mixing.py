import duckdb
import pandas as pd
import pytest

from rulewright.llm import mixing


def both(spark, rows, **how):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, domain string, n_tokens int").repartition(3)
    got = mixing.mix(docs, bucket_rows=3, **how).toPandas()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"}))
    keep = {k: v for k, v in how.items() if k != "total"}
    want = con.sql(mixing.oracle_sql(**keep)).df()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).where(df.notna(), None).itertuples(index=False, name=None)))
    clean = lambda df: df.assign(doc_id=df["doc_id"].astype("Int64").astype(str))
    assert key(clean(got)) == key(clean(want))
    return got


ROWS = [(i, "w " * (i % 7 + 1), ["en", "de", None][i % 3], ["src0", "src1", "src2", None, "other"][i % 5]) for i in range(120)]
ODD = [(None, None, None, None), (5, "", "en", "src1"), (5, "", "en", "src1"), (7, "a b", "fr", "src99999999999"), (7, "a b", "fr", "src99999999999"), (200, "long " * 3000, "es", "src3")]


@pytest.mark.parametrize("part", [(0, 1), (1, 10), (3, 5), (2, 1), (9, 1)])
def test_same_as_sql(spark, part):
    got = both(spark, ROWS + ODD, part=part)
    if part == (9, 1):  # more than four epochs of everything can give: all is read as often as it may be
        assert (got["copies"] == 4).sum() >= len(ROWS)


def test_shortage_goes_to_siblings_first(spark):
    rows = [("d0", "en", "a", 10), ("d0", "en", "b", 1000), ("d0", "fr", "c", 1000), ("d1", "en", "e", 1000)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
    got = {r.source: r.budget for r in mixing.allocate(leaves, 400, 1, {}, 1).collect()}
    assert got == {"a": 10, "b": 90, "c": 100, "e": 200}
    rows[1] = ("d0", "en", "b", 20)
    got = {r.source: r.budget for r in mixing.allocate(spark.createDataFrame(rows, "domain string, lang string, source string, tokens long"), 400, 1, {}, 1).collect()}
    assert got == {"a": 10, "b": 20, "c": 170, "e": 200}


def test_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def test_selected_rows_are_those_of_one_epoch(spark):
    docs = spark.createDataFrame(ROWS + ODD, "doc_id long, text string, lang string, source string").withColumn("n_chars", mixing.F.lit(1).cast("long"))
    for limit in (50_000, 0):
        got = sorted(str((r.doc_id, r.lang or "unknown", r.source or "unknown")) for r in mixing.select_documents(docs, part=(1, 2), bucket_rows=3, max_plan_rows=limit).collect())
        want = sorted(str((r.doc_id, r.lang, r.source)) for r in mixing.mix(docs, part=(1, 2), max_epochs=1).collect())
        assert got == want and len(got) > 20
    assert mixing.select_documents(docs).columns == docs.columns

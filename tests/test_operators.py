import duckdb
import pandas as pd
import pytest

from rulewright import operators
from rulewright.plans.sql import BASE


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    clean = lambda x: None if x is None or (not isinstance(x, (list, tuple)) and pd.isna(x)) else round(float(x), 6) if isinstance(x, (int, float)) or hasattr(x, "dtype") and x.dtype.kind in "if" else str(x)
    return sorted(str([clean(v) for v in r]) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("key", sorted(operators.OPERATORS))
def test_same_as_sql(spark, duck, sf, key):
    got, want = operators.from_tables(spark, key, sf).toPandas(), duck.sql(operators.oracle(key)).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) and rows(got) == rows(want)

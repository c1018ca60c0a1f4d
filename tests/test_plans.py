"""Every table query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import pandas as pd
import pytest

from deckframe.plans import deck_oracle, decks, oracle, tables

SF = "/root/testdata/sf0.001"
NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in NAMES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df):
    def clean(x):
        x = x.item() if hasattr(x, "item") else x
        if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and math.isnan(x):
            return None
        return int(x) if isinstance(x, float) and x.is_integer() else x

    return sorted(repr(tuple(map(clean, r))) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


QUERIES, ORACLE = tables.QUERIES | decks.QUERIES, oracle.ORACLE | deck_oracle.ORACLE


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLE:
        assert len(got)
        return
    assert rows(got) == rows(duck.execute(ORACLE[name]).df())


def test_entry_module():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())

"""Every catalogue query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from quarry import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]
    plain = [[None if x is None or (isinstance(x, float) and x != x) else x.item() if hasattr(x, "item") else x for x in r] for r in df.itertuples(index=False, name=None)]
    return sorted(map(repr, plain))


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, sf, duck, name):
    assert rows(catalog.QUERIES[name](spark, sf).toPandas()) == rows(duck.execute(catalog.ORACLES[name]).df())


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)

"""Every query with SQL gives what DuckDB gives on the same tables; every other one gives rows."""

import math

import duckdb
import numpy as np
import pytest

from skerry.plans import catalog, catalog_functions, catalog_models, catalog_more  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def key(row):
    return tuple((v is None, str(type(v)), "" if v is None else v) for v in row)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    assert len(got.columns)
    if name not in catalog.ORACLES:
        assert len(got)
        return
    want = duck.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)

    def table(frame):
        frame = frame[sorted(frame.columns)]
        out = []
        for r in frame.astype(object).itertuples(index=False):
            out.append(tuple(None if v is None or isinstance(v, float) and math.isnan(v) else (v.item() if hasattr(v, "item") else v) for v in r))
        return sorted(out, key=key)

    assert table(got) == table(want)

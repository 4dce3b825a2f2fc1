"""Every query against its oracle on a second engine, on the smallest tables where they are dense enough."""

import os

import duckdb
import numpy as np
import pytest

from tideframe.plans import registry

SF = "/root/testdata/sf0.01"
#: Columns that name a row.
KEYS = {"w", "i", "j", "t", "seed", "node", "comm", "replicate", "measure", "family", "series", "lag", "component", "method"}
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def tidy(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].astype("float64").round(5) if df[c].dtype != object and df[c].dtype != bool else df[c].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(name, spark, duck):
    got, want = tidy(registry.queries()[name](spark, SF).toPandas()), tidy(duck.sql(registry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        if got[c].dtype == object:
            assert (got[c] == want[c].astype(object)).all(), c
        else:
            assert np.allclose(got[c], want[c].astype(float), atol=2e-5, equal_nan=True), c


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_rows(name, spark):
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    got = registry.queries()[name](spark, SF).toPandas()
    assert len(got) and not got[[c for c in got.columns if c in KEYS]].isna().any().any()

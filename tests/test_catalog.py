"""Every registered query against its DuckDB statement on the smallest dataset."""

import glob
import os

import duckdb
import pytest

from authspan.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(df):
    df = df[sorted(df.columns)].astype(str).replace({"<NA>": "nan", "None": "nan", "NaT": "nan"})
    return sorted(map(tuple, df.values.tolist()))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    out = catalog.QUERIES[name](spark, DATA).toPandas()
    assert len(out) and len(out.columns)

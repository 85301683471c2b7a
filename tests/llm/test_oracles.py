"""Registered queries against their DuckDB statements."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from authspan.llm import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    cell = lambda v: "null" if pd.isna(v) else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)  # noqa: E731  a column with nulls comes as floats
    plain = lambda df: sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))
    assert plain(registry.QUERIES[name](spark, DATA).toPandas()) == plain(con.execute(registry.ORACLES[name]).df())

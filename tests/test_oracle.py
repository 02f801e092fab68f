"""Every query with SQL gives the same rows in DuckDB."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from sigspark import queries as catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


class tables:
    """DuckDB over a folder's tables."""

    def __init__(self, folder):
        self.folder, con = folder, duckdb.connect()
        self.execute = con.execute
        for path in glob.glob(f"{folder}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")


@pytest.fixture(scope="module")
def duck():
    return tables(SF)


def ordered(df):
    """Rows in an order that last digits do not change."""
    df = df[sorted(df.columns)].copy()
    coarse = pd.DataFrame({c: df[c].astype(float).round(5) + 0.0 if df[c].dtype.kind in "fiub" or str(df[c].dtype).startswith("Int") else df[c].astype(str) for c in df.columns})
    return df.loc[coarse.sort_values(list(coarse.columns), kind="stable").index].reset_index(drop=True)


def check(spark, duck, name):
    ours, theirs = ordered(catalogue.QUERIES[name](spark, duck.folder).toPandas()), ordered(duck.execute(catalogue.SQL[name]).df())
    assert list(ours.columns) == list(theirs.columns) and len(ours) == len(theirs)
    for c in ours.columns:
        if ours[c].dtype.kind in "fiub" or str(ours[c].dtype).startswith("Int"):
            # Finer than the sixth digit: a tie that the engines round apart shows.
            np.testing.assert_allclose(ours[c].astype(float), theirs[c].astype(float), rtol=1e-9, atol=2e-7, err_msg=f"{name}.{c}")
        else:
            assert ours[c].astype(str).equals(theirs[c].astype(str)), c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_parity(spark, duck, name):
    check(spark, duck, name)


@pytest.mark.parametrize("name", ["linear_repair", "crackle_events", "levels_round_trip"])
def test_parity_of_more_rows(spark, name):
    check(spark, tables("/root/testdata/sf0.01"), name)


def test_every_query_has_a_name_of_its_own():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES) and len(catalogue.QUERIES) >= 50

"""Every terrain query runs, and equals its DuckDB twin where it has one."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from gridmesa.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    """A value as a string that does not depend on the library it came from; missing ones, and NaN, are None."""
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list | tuple):
        return str([_plain(x) for x in v])
    return None if pd.isna(v) else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)


def _rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted((tuple(map(_plain, row)) for row in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, oracle, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    assert len(got.columns)
    if name in catalogue.ORACLES:
        assert _rows(got) == _rows(oracle.sql(catalogue.ORACLES[name]).df())


def test_whole_analysis_takes_every_building(spark, monkeypatch):
    from gridmesa.plans import analysis

    monkeypatch.setattr(analysis, "analyze", lambda walk, buildings, resources: {"buildings": buildings})
    assert [tuple(r) for r in catalogue.QUERIES["q21_analyze"](spark, SF).collect()] == [("buildings", spark.read.parquet(f"{SF}/nation.parquet").count())]

"""Every registered query of the base library against its SQL, at the smallest scale."""

import os

import duckdb
import pandas as pd
import pytest

from tessera.plans import registry
from tessera.plans.project import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{p + '/*' if os.path.isdir(p) else p}')")
    return con


def cell(v):
    if v is None or not hasattr(v, "__len__") and pd.isna(v):
        return None
    if isinstance(v, str):
        return v
    f = float(v)
    return int(f) if f.is_integer() else f


def rows(frame):
    return sorted((tuple(cell(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    sql = registry.oracles().get(name)
    if sql:
        want = duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got.toPandas()) == rows(want)
    else:
        assert got.columns and got.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

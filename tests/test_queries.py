"""Every query of the catalog against its DuckDB SQL."""

import os

import duckdb
import pytest

from ledgerloom import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(value):
    if value is None or value != value:
        return None
    if hasattr(value, "year"):
        return str(value)[:19].removesuffix(" 00:00:00")
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return bool(value)
    return float(value) if isinstance(value, (int, float)) or hasattr(value, "dtype") else value


def rows(df):
    names = sorted(df.columns)
    return names, sorted(repr(tuple(map(plain, r))) for r in df[names].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_query_matches_sql(spark, sf_dir, duck, name):
    got, want = catalog.queries()[name](spark, sf_dir).toPandas(), duck.execute(catalog.oracles()[name]).df()
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracles())))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0

"""Every registered query against its DuckDB oracle on the smallest tables,
and the driver contract of ``__spark_entry__``."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def _norm(x):
    if isinstance(x, float):
        return round(x, 6) if not math.isnan(x) else "nan"
    return x


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda c: cols[c])
    return sorted((tuple(_norm(r[c]) for c in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_contract_keys():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 40


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["i", "j", "v"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = con.sql(E.oracle_sql()[name])
    assert sorted(df.columns) == sorted(res.columns)
    assert _canon(df.columns, rows) == _canon(res.columns, res.fetchall())

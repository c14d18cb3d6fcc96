"""Every registered query against its SQL on DuckDB."""

import math

import duckdb
import pytest

from tabulyze.plans.catalog import ORACLES, QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    yield con
    con.close()


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x + 0.0)
    return x.isoformat() if hasattr(x, "isoformat") else str(x)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = df.collect()
    result = duck.execute(ORACLES[name])
    names, types = [d[0] for d in result.description], {d[0]: str(d[1]) for d in result.description}
    want = result.fetchall()
    order = sorted(df.columns)
    assert order == sorted(names)
    assert len(got) == len(want)
    rows = sorted(tuple(_cell(r[c]) for c in order) for r in got)
    place = [names.index(c) for c in order]
    assert rows == sorted(tuple(_cell(r[i]) for i in place) for r in want)
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == types


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0

"""Every registered query against its SQL on the same tables."""

import math

import duckdb
import pytest
from quillstone.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    from conftest import SMALL

    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return connection


def plain(value):
    if type(value).__name__ == "Decimal":
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6))
    return value.isoformat() if hasattr(value, "isoformat") else repr(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    if name not in ORACLES:
        assert mine
        return
    result = duck.execute(ORACLES[name])
    theirs = [d[0] for d in result.description]
    assert sorted(theirs) == names
    at = [theirs.index(c) for c in names]
    assert mine == sorted(tuple(plain(row[k]) for k in at) for row in result.fetchall())

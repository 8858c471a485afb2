"""Every registered query of the memory store: against its SQL where it has one, else that it gives rows."""

import math

import duckdb
import pytest

from reverie.plans import ORACLES, QUERIES
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def compared(frame, cursor):
    columns = sorted(frame.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in frame.collect()), key=str)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(([plain(r[i]) for i in at] for r in cursor.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sql, name):
    compared(QUERIES[name](spark, DATA), sql.execute(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0

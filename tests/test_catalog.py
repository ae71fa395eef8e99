"""Every query of the library against its SQL on the smallest tables, and the entry points."""

import decimal
import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from tallymark.plans import catalog_eval, catalog_more, catalog_plays, catalog_serving

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = {name: query for c in (catalog_plays, catalog_eval, catalog_serving, catalog_more) for name, query in c.QUERIES.items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return v.normalize() + 0
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(OWN))
def test_query(spark, duck, name):
    df = OWN[name](spark, DATA)
    cols = sorted(df.columns)
    rows = Counter(str([plain(r[c]) for c in cols]) for r in df.collect())
    assert rows
    if name in (sql := entry.oracle_sql()):
        cur = duck.execute(sql[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        assert rows == Counter(str([plain(r[names.index(c)]) for c in cols]) for r in cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

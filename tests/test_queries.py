"""Every query that SQL can express against that SQL, over the smallest tables."""

import duckdb
import numpy as np
import pytest

from barline.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and np.isnan(v):
        return None
    if hasattr(v, "isoformat"):
        return str(v)[:10]
    return round(float(v), 4) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, FOLDER)
    names = sorted(got.columns)
    cursor = duck.execute(catalog.ORACLE_SQL[name])
    said = [c[0] for c in cursor.description]
    assert sorted(said) == names
    key = lambda r: [str(v) for v in r]
    mine = sorted(([plain(r[c]) for c in names] for r in got.collect()), key=key)
    want = sorted(([plain(r[said.index(c)]) for c in names] for r in cursor.fetchall()), key=key)
    assert mine == want

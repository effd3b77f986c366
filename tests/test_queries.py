"""Every query with SQL against DuckDB; the others for their shape."""

import math
from collections import Counter

import duckdb
import pytest

from tocsin.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name not in ORACLE_SQL:
        assert got
        return
    res = duck.execute(ORACLE_SQL[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(range(len(cols)), key=cols.__getitem__)
    want = [tuple(plain(r[k]) for k in order) for r in res.fetchall()]
    assert len(got) == len(want)
    a, b = Counter(got), Counter(want)
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])

"""Each query against its SQL on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from lemmata.catalogue import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents labels".split()


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for n in NAMES:
        c.execute(f"create view {n} as select * from '{DATA}/{n}.parquet'")
    return c


def norm(x):
    return float(f"{x:.9g}") if isinstance(x, float) else x


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, DATA)
    want = oracle.sql(SQL[name])
    columns = want.columns
    assert sorted(df.columns) == sorted(columns)
    got = Counter(tuple(norm(r[c]) for c in columns) for r in df.collect())
    assert got == Counter(tuple(map(norm, r)) for r in want.fetchall())

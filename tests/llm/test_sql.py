import duckdb
import pytest

from lemmata.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(str(tuple(r)) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = c.sql(SQL[name])
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)
    columns = [x for x in want.columns if x not in ("position", "target")]
    assert plain(got.select(*columns).collect()) == plain(want.select(*columns).fetchall())

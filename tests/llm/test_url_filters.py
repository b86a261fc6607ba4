import datetime as dt

import duckdb
from pyspark.sql import functions as F

from lemmata.llm import url_filters as uf

ENTRIES = "list string, kind string, pattern string, action string, day string"
D = dt.date


def test_as_of_join_against_brute_force(spark):
    entries = [
        ("block", "domain", "bad.org", "add", "2024-01-10"), ("block", "domain", "bad.org", "remove", "2024-02-01"), ("block", "domain", "bad.org", "add", "2024-03-01"), ("block", "domain", "bad.org", "add", "2024-04-01"),
        ("block", "host", "x.io", "add", "2024-01-01"), ("block", "prefix", "y.io/a/b", "add", "2024-01-01"), ("allow", "host", "ok.bad.org", "add", "2024-03-15"),
        ("block", "host", "z.io", "add", "2024-01-05"), ("block", "host", "z.io", "remove", "2024-01-05"), (None, "host", "w.io", "add", "2024-01-01"), ("block", "host", "w.io", "add", None),
    ]
    urls = ["http://BAD.org/", "https://a.bad.org:8080/x", "http://notbad.org/", "http://u@ok.bad.org./q", "http://x.io", "http://sub.x.io", "http://y.io/a/b", "http://y.io/a/bc", "http://y.io//a/b/c?d#e", "http://z.io/", "http://w.io", None, "", "no url", "mailto:x@bad.org"]
    days = [None, *(D(2024, 1, 1) + dt.timedelta(n) for n in range(0, 120, 7)), D(2024, 1, 10), D(2024, 2, 1), D(2024, 1, 5)]
    rows = [(i, u, d, "x") for i, (u, d) in enumerate((u, d) for u in urls for d in days)] + [(0, urls[0], days[3], "x")] * 2
    out = uf.judge(spark.createDataFrame(rows, "page int, url string, at date, kind string"), spark.createDataFrame(entries, ENTRIES), "page", "url", "at").collect()

    def active(kind, pattern, list_, day):
        on = sorted((e[4], e[3] == "add") for e in entries if e[:3] == (list_, kind, pattern) and e[4] and e[4] <= str(day))
        return bool(on) and on[-1][1]

    def brute(u, d):
        h = {0: "bad.org", 1: "a.bad.org", 2: "notbad.org", 3: "ok.bad.org", 4: "x.io", 5: "sub.x.io", 6: "y.io", 7: "y.io", 8: "y.io", 9: "z.io", 10: "w.io"}.get(urls.index(u))
        if h is None or d is None:
            return False
        block = (h == "bad.org" or h.endswith(".bad.org")) and active("domain", "bad.org", "block", d) or active("host", h, "block", d) or urls.index(u) in (6, 8) and active("prefix", "y.io/a/b", "block", d)
        return bool(block) and not active("host", h, "allow", d)

    assert len(out) == len(rows)
    assert all(r["blocked"] == brute(r["url"], r["day"]) for r in out)
    assert uf.judge(spark.createDataFrame([], "page int, url string, at date"), spark.createDataFrame(entries, ENTRIES), "page", "url", "at").count() == 0
    assert not any(r["blocked"] for r in uf.judge(spark.createDataFrame(rows, "page int, url string, at date, kind string"), spark.createDataFrame([], ENTRIES), "page", "url", "at").collect())


def test_sql(spark):
    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{d}/pages.parquet'")
    df = uf.op3_url_filters(spark, d)
    want = c.sql(f"select {', '.join(df.columns)} from ({uf.SQL.strip()})").fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def test_days_of_large_ids(spark):
    ids = [0, 1, 729, 730, 10**6, 2**62, 2**63 - 1, -5]
    got = [r["d"] for r in spark.createDataFrame([(i,) for i in ids], "i long").select(uf.fetched(F.col("i")).alias("d")).collect()]
    assert [(d - D(2024, 1, 1)).days for d in got] == [i * 7919 % 730 for i in ids]

import random

import duckdb
import pytest

from lemmata.llm import mixing

SCHEMA = "doc_id long, text string, source string, lang string"


def test_targets_share_the_excess():
    t = mixing.targets([("a", 10), ("b", 1000), ("c", 10), (None, 500)])
    assert t["a"] == 20 and t["c"] == 20  # capped
    assert abs(sum(t.values()) - 1.5 * 1520) < 1e-6
    assert (t["b"], t[None]) == (1240, 1000)  # null comes last and is capped too
    assert mixing.targets([]) == {} and mixing.targets([("a", 0)]) == {"a": 0.0}


def test_due_inverts_the_schedule(spark):
    from pyspark.sql import functions as F

    for s in mixing.CURRICULUM:
        knots = mixing.integrated(s)
        df = spark.range(0, 101).withColumn("k", F.lit(None)).select((F.col("id") / 100).alias("x"))
        col = F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(k, "twa", strict=True))) for k in knots))
        for r in df.select("x", mixing.due(F.col("x") * 50, F.lit(50.0), col).alias("t")).collect():
            area = 0.0
            for (t1, w1, _), (t2, w2, _) in zip(knots, knots[1:], strict=False):
                e = min(max(r["t"], t1), t2)
                area += (e - t1) * (w1 + (w1 + (w2 - w1) * (e - t1) / (t2 - t1))) / 2
            assert area == pytest.approx(r["x"], abs=1e-9)


def test_targets_in_windows(spark):
    rng = random.Random(1)
    for case in range(6):
        sizes = [(f"s{i}", rng.choice([0, 1, 7, 500, 10_000, 10_000])) for i in range(rng.randint(0, 12))] + [(None, 40)] * (case % 2)
        got = {r["source"]: r["target"] for r in mixing.with_targets(spark.createDataFrame(sizes, "source string, n long")).collect()}
        assert got == pytest.approx(mixing.targets(sizes), abs=1e-6)


def test_hot_ids_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE_ROWS", 20)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    rows = [(None, "a b c", "s", 1, "x") for _ in range(300)] + [(7, "a b", "s", 1, "x")] * 200 + [(i, "w " * (i % 5), "t", 1, "x") for i in range(100)] + [(9, "v " * 2_000_000, "u", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, _row string")
    out = mixing.with_shares(docs).collect()
    assert len(out) == len(rows)
    for s in "stu":
        g = sorted((r["start"], r["size"]) for r in out if r["source"] == s and r["size"])
        assert g[0][0] == 0 and all(b[0] == a[0] + a[1] for a, b in zip(g, g[1:], strict=False))  # gapless
        taken = sum(r["taken"] for r in out if r["source"] == s)
        assert abs(taken - next(r["target"] for r in out if r["source"] == s)) <= 1


@pytest.mark.parametrize("slice_rows", [3, 500])
def test_shares(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(mixing, "SLICE_ROWS", slice_rows)
    rows = [(i, "w " * (i % 17), "s" + str(i % 3), "x") for i in range(200)] + [(500, None, None, "x"), (501, "a b", None, "x"), (501, "a b", None, "x"), (None, "q", "s0", "x"), (502, "z" * 9, "empty", "y")]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixing.with_shares(docs).collect()
    assert len(out) == len(rows)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    by = {}
    for r in out:
        by.setdefault(r["source"], []).append(r)
        assert r["taken"] == sum(x["words"] for x in r["readings"])
        assert all(0 <= x["position"] <= 1 for x in r["readings"])
    for g in by.values():
        assert abs(sum(r["taken"] for r in g) - g[0]["target"]) <= 1
    again = mixing.with_shares(docs.repartition(5)).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"], r["start"])
    assert sorted(map(key, out)) == sorted(map(key, again))
    ordered = mixing.in_training_order(mixing.with_shares(docs)).collect()
    assert [r["position"] for r in ordered] == sorted(r["position"] for r in ordered)
    assert mixing.with_shares(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sql(spark):
    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{d}/documents.parquet'")
    names = "doc_id, size, source_size, target, taken, start, n_readings, position"
    want = sorted(map(str, c.sql(f"select {names} from ({mixing.SQL.strip()})").fetchall()))
    got = mixing.op7_mixing(spark, d).select(*names.split(", ")).collect()
    assert sorted(str(tuple(r)) for r in got) == want

from weather import bag, rows, start

from lemmata import cond, eq, f, insert, query, rule, v
from lemmata.sources import durability
from lemmata.streaming.feed import Feed
from lemmata.tools import inspect

COLD = rule("cold", [cond("Temperature", eq(v("t"), f("temperature")), f("temperature") < 20)], insert("Cold", temperature=v("t")))
Q = query("q", [cond("Cold", eq(v("t"), f("temperature")))])


def test_round_trip(spark, tmp_path):
    for i, r in enumerate([COLD, rule("cold", list(COLD.when), COLD.then, no_loop=True)]):
        s = start(spark, r, Q).insert("Temperature", [(10, "a"), (10, "b"), (30, "c")]).fire()
        path = f"file://{tmp_path}/{i}"
        durability.save(s, path)
        again = durability.load(spark, path)
        assert bag(again.query("q")) == bag(s.query("q")) == rows({"t": 10}, {"t": 10})
        assert bag(again.retract("Temperature", [(10, "a")]).fire().query("q")) == rows({"t": 10})


def test_inspection(spark):
    s = start(spark, COLD, Q).insert("Temperature", [(10, "a"), (30, "b")]).fire()
    m = inspect.rule_matches(s, "cold").collect()
    assert [(r["t"], len(r["matched"])) for r in m] == [(10, 1)]
    edges = inspect.fact_graph(s).collect()
    assert sorted(e["kind"] for e in edges) == ["insert", "match"]
    by = {e["kind"]: e for e in edges}
    assert by["match"]["target"] == by["insert"]["source"]
    assert "cold" in inspect.explain(s)
    assert inspect.condition_matches(s, "Temperature", f("temperature") > 20).count() == 1
    assert inspect.insertions(s).count() == 1


def test_feed(spark, tmp_path):
    src = f"{tmp_path}/in"
    schema = "temperature bigint, location string, op string"
    spark.createDataFrame([(10, "a", "insert"), (12, "b", "insert")], schema).coalesce(1).write.parquet(f"{src}/1")
    seen = []
    feed = Feed(start(spark, COLD, Q), "Temperature", lambda s, epoch: seen.append(s.query("q").count()))
    stream = spark.readStream.schema(schema).parquet(f"{src}/*")
    run = feed.start(stream, f"{tmp_path}/cp", availableNow=True)
    run.awaitTermination()
    spark.createDataFrame([(10, "a", "retract")], schema).coalesce(1).write.parquet(f"{src}/2")
    run = feed.start(stream, f"{tmp_path}/cp", availableNow=True)
    run.awaitTermination()
    assert seen == [2, 1]
    assert bag(feed.session.query("q")) == rows({"t": 12})


def test_feed_goes_on_after_a_restart(spark, tmp_path):
    src, schema = f"{tmp_path}/in", "temperature bigint, location string, op string"
    stream = lambda: spark.readStream.schema(schema).parquet(f"{src}/*")
    for n, changes in enumerate(([(10, "a", "insert"), (12, "b", "insert")], [(10, "a", "retract"), (14, "c", "insert")], [(12, "b", "retract")])):
        spark.createDataFrame(changes, schema).coalesce(1).write.parquet(f"{src}/{n}")
        feed = Feed(start(spark, COLD, Q), "Temperature", store=f"file://{tmp_path}/kept")  # a new driver each time
        feed.start(stream(), f"{tmp_path}/cp", availableNow=True).awaitTermination()
    assert bag(feed.session.query("q")) == rows({"t": 14})
    feed = Feed(start(spark, COLD, Q), "Temperature", store=f"file://{tmp_path}/kept")
    feed.batch(spark.createDataFrame([(14, "c", "retract")], schema), 2)  # stored already, so skipped
    assert bag(feed.session.query("q")) == rows({"t": 14}) and len(feed._kept()) == 2


def test_explanations_and_ranking_of_a_plan(spark):
    s = start(spark, COLD, Q).insert("Temperature", [(10, "a"), (11, "b"), (30, "b")]).fire()
    assert s.mode != "agenda" and inspect.ranked_productions(s)[0] == ("cold", 2)
    found = inspect.explanations(s).collect()
    assert len(found) == 2 and all(r["rule"] == "cold" and len(r["matched"]) == 1 for r in found)


def test_full_logging_and_listeners_take_a_plan_over(spark):
    events = []
    s = start(spark, COLD, Q).insert("Temperature", [(10, "a")]).fire().with_listener(lambda *e: events.append(e)).with_full_logging()
    assert ("fire-activations", "cold", 1) in events and bag(s.query("q")) == rows({"t": 10})
    s = s.insert("Temperature", [(12, "b")]).fire().retract("Temperature", [(10, "a")]).fire()
    fired = inspect.activations_fired(s, "cold").collect()
    assert {r["bindings"] for r in fired} >= {'{"t":12}'} and bag(s.query("q")) == rows({"t": 12})
    assert ("retract-activations", "cold", 1) in events and inspect.trace(s)


def test_stored_tables_go(spark, tmp_path, monkeypatch):
    from lemmata.operators import store

    monkeypatch.setattr(store, "folder", lambda spark: f"file://{tmp_path}/own")
    df = store.stored(spark.range(3))
    assert df.count() == 3 and (tmp_path / "own").exists()
    store.cleared(spark)
    assert not (tmp_path / "own").exists()


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from lemmata.operators import store

    def given(base, master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: base), sparkContext=SimpleNamespace(master=master, applicationId="app-1"))

    assert store.folder(given("hdfs://x/", "yarn")) == "hdfs://x/app-1"
    assert store.folder(given(None, "local[4]")).startswith("file://")
    with pytest.raises(RuntimeError, match="share"):
        store.folder(given(None, "yarn"))

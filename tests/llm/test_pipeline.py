import corpus_pipeline
from lemmata.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def test_stages_and_queries():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dups", "secrets", "mixing", "packing"]
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in QUERIES)] == []


def test_each_stage_takes_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "a clean line without an id", "en", "s", 3), (10**6, "", "en", None, 0), (10**6 + 1, "here token = abcdef123456 ends", "en", "s", 30)], docs.schema)
    rows = docs.unionByName(odd)
    good = corpus_pipeline.quality(spark, rows, DATA)
    assert good.columns == docs.columns and 0 < good.count() <= rows.count()
    once = corpus_pipeline.dedup(spark, rows.unionByName(docs.limit(5)), DATA)
    ids = [r["doc_id"] for r in once.select("doc_id").collect()]
    assert len(ids) - ids.count(None) == len(set(ids) - {None}) < docs.count() and ids.count(None) == 2
    safe = corpus_pipeline.redact(spark, rows, DATA)
    assert safe.count() == rows.count() and safe.where("text like '%[SECRET]%'").count() > 0
    mixed = corpus_pipeline.mix(spark, rows, DATA)
    words = mixed.select(corpus_pipeline.mixing.size(mixed["text"]).alias("n")).groupBy().sum("n").first()[0]
    whole = rows.select(corpus_pipeline.mixing.size(rows["text"]).alias("n")).groupBy().sum("n").first()[0]
    assert abs(words - 1.5 * whole) < 40 and mixed.columns == docs.columns
    assert corpus_pipeline.run(spark, DATA).where("length <> size(ids)").count() == 0


def test_near_dups_stage_links_from_80(spark):
    w = [f"w{i}" for i in range(104)]
    changed = lambda *at: " ".join("x" if i in at else x for i, x in enumerate(w))
    rows = [(1, changed()), (2, changed(20, 60)), (3, changed(20, 40, 60))]  # 1 and 2: 90 of 110, 2 and 3: 95 of 105
    rows += [(11, changed(0, 5, 10, 15, 20, 25, 30, 35)), (21, "a b c d e f g h"), (22, "a b c d e f g h i")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], spark.read.parquet(f"{DATA}/documents.parquet").schema)
    stage = dict(corpus_pipeline.STAGES)["near_dups"]
    assert sorted(r["doc_id"] for r in stage(spark, docs, DATA).collect()) == [1, 11, 21]


def test_clashing_and_extra_columns(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    names = ["score", "size", "_id", "_row", "__row", "__id", "__quality", "__r", "quality", "row", "k1", "t", "r", "cut", "a.b", "id", "k", "n", "position", "readings", "target"]
    rows = docs.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, DATA)
        assert rows.columns == [*docs.columns, *names] and rows.count() > 0
    assert [tuple(r) for r in rows.select(*(f"`{n}`" for n in names)).distinct().collect()] == [tuple(range(len(names)))]
    empty = spark.createDataFrame([], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0


def test_stages_against_plain_versions(spark):
    """Each stage against the same decision made row by row on the driver."""
    import pyarrow as pa
    from test_dedup import brute, shingles

    from lemmata.llm import quality_crf, secrets
    from lemmata.llm.labelled import fold

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    field = quality_crf.fitted(docs, spark.read.parquet(f"{DATA}/labels.parquet"), lambda d: fold(d, 5) != 0)
    scores = quality_crf.scores(field, pa.array([r["text"] for r in rows]))
    good = {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, DATA).collect()}
    assert good == {r["doc_id"] for r, s in zip(rows, scores, strict=True) if s >= 0.3}
    stage = dict(corpus_pipeline.STAGES)["near_dups"]
    kept = [r["doc_id"] for r in stage(spark, docs, DATA).collect()]
    assert sorted(kept) == sorted(i for i, _, _, k in brute([(r["doc_id"], r["text"]) for r in rows], 80) if k)
    assert all(shingles(r["text"]) or r["doc_id"] in kept for r in rows)
    model = secrets.fitted(docs)
    clean = {r["doc_id"]: r for r in corpus_pipeline.redact(spark, docs, DATA).collect()}
    for r in rows:
        want = secrets.redacted(r["text"], secrets.all_spans(r["text"], secrets.base_spans(r["text"]), model))
        assert clean[r["doc_id"]]["text"] == want and clean[r["doc_id"]]["n_chars"] == len(want)
    mixed = corpus_pipeline.mix(spark, docs, DATA).collect()
    times = {}
    for r in mixed:
        times.setdefault(r["doc_id"], []).append(r["text"])
    taken = plain_mix(rows)
    for r in rows:
        words = sum(len(t.split()) for t in times.get(r["doc_id"], []))
        assert words == taken[r["doc_id"]]
        assert all(t == r["text"] or r["text"].split()[: len(t.split())] == t.split() for t in times.get(r["doc_id"], []))


def plain_mix(rows):
    """Words taken of each document, counted out document by document."""
    import hashlib

    groups, out = {}, {}
    for r in rows:
        groups.setdefault(r["source"], []).append((hashlib.md5(str(r["doc_id"]).encode()).hexdigest(), len(r["text"].split()), r["doc_id"]))
    order = sorted(groups, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    size = {s: sum(n for _, n, _ in groups[s]) for s in order}
    target, open_, left = {}, set(order), 1.5 * sum(size.values())
    while open_:
        rate = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if rate * weight[s] > 2 * size[s]}
        if not full:
            target |= {s: rate * weight[s] for s in open_}
        target |= {s: 2 * size[s] for s in full}
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    for s in order:
        left = round(target[s])
        for _, n, i in 2 * sorted(groups[s]):
            out[i] = out.get(i, 0) + min(n, left)
            left -= min(n, left)
    return out


def test_unlike_texts_of_one_id_stay(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = spark.createDataFrame([(1, a, "en", "s", 1), (1, b, "en", "s", 1), (1, b, "en", "s", 1), (2, a + " c", "en", "s", 1), (None, a, "en", "s", 1), (3, None, "en", None, None), (3, None, "en", None, None)], docs.schema)
    once = dict(corpus_pipeline.STAGES)["near_dups"](spark, rows, DATA)
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in once.collect()) == sorted([("1", a), ("1", b), ("None", a), ("3", "None"), ("3", "None")])
    mixed = corpus_pipeline.mix(spark, rows, DATA).collect()  # one source with words: one and a half readings
    assert sum(len(r["text"].split()) for r in mixed) == 452
    for t, n in ((a, 120), (b, 120), (a + " c", 61)):
        assert n <= sum(len(r["text"].split()) for r in mixed if t.startswith(r["text"]) and (r["text"] != a or t == a)) <= 2 * n + 61


def test_text_of_ten_megabytes(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = spark.createDataFrame([(1, "\n".join(" ".join(f"w{i * 7 + k}" for k in range(12)) for i in range(120_000)), "en", "s", 1), (2, "a b c", "en", "s", 5)], docs.schema)
    for name, stage in corpus_pipeline.STAGES[1:]:
        rows = stage(spark, rows, DATA)
        assert rows.count() >= 2, name
    assert rows.groupBy("doc_id").sum("length").count() == 2

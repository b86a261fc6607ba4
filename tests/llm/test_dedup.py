import hashlib
import random
import string

import numpy as np
import pyarrow as pa
import pytest

from lemmata.llm import components as components_module
from lemmata.llm import near_dups as nd
from lemmata.llm import suffix_dedup as sd
from lemmata.llm.components import Forest, components
from lemmata.llm.losertree import common, decoded, front_coded, merged

SCHEMA = "doc_id long, text string, id long, n int, k string"


def shingles(text):
    w = "".join(c.lower() if c in string.ascii_uppercase else c for c in text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, percent=85):
    """Nodes are rows, so that an id may stand for several texts."""
    sets = [(i, shingles(t)) for i, t in rows]
    f = Forest()
    for a, (i, x) in enumerate(sets):
        for b, (j, y) in enumerate(sets[:a]):
            if x and y and None not in (i, j) and 100 * len(x & y) >= percent * len(x | y):
                f.join(a, b)
    least = {}
    for a, (i, _) in enumerate(sets):
        least[f.find(a)] = min(least.get(f.find(a), i), i) if i is not None else None
    return sorted(((i, len(x), least[f.find(a)], least[f.find(a)] == i) for a, (i, x) in enumerate(sets)), key=str)


def near_rows(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdef", k=rng.randint(2, 5)))
    rows = [(900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "one TWO"), (905, "one two three four five"), (906, "One two three four five six"), (906, "One two three four five six"), (907, "ÀB c d e f g"), (908, "àb c d e f g")]
    base = [word() for _ in range(120)]
    for i in range(150):  # a crowded group at all similarities
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    for i in range(200, 260):
        w = [word() for _ in range(rng.randint(6, 90))]
        rows += [(i, " ".join(w)), (i + 100, " ".join([*w[:-1], word()]))]
    return rows


@pytest.mark.parametrize("region", [nd.REGION, 8])
def test_near_duplicates_against_brute_force(spark, monkeypatch, region):
    monkeypatch.setattr(nd, "REGION", region)
    monkeypatch.setattr(nd, "ASKING", 7)
    monkeypatch.setattr(nd, "ASKED", 11)
    rows = near_rows(region)
    out = nd.near_duplicates(spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], SCHEMA)).collect()
    assert sorted(map(tuple, out), key=str) == brute(rows)
    assert nd.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_id_with_unlike_texts(spark):
    rng = random.Random(11)
    text = lambda: " ".join("".join(rng.choices("abcdef", k=5)) for _ in range(40))
    a, b = text(), text()
    rows = [(1, a), (1, b), (2, a + " w"), (3, b + " v"), (3, text()), (None, a), (None, a), (4, a), (4, a), (1, a), (5, None), (5, b.upper())]
    docs = spark.createDataFrame([(i, t, n, "x", None) for n, (i, t) in enumerate(rows)], "doc_id int, text string, t long, `row` string, `first.id` string")
    assert sorted(map(tuple, nd.near_duplicates(docs).collect()), key=str) == brute(rows)
    kept = nd.one_of_each(docs, 85)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert got == sorted([(1, a), (1, b), (3, rows[4][1]), (None, a), (None, a), (5, None)], key=str)


def test_text_of_ten_megabytes(spark):
    rng = random.Random(12)
    long = " ".join(str(rng.randint(0, 10**6)) for _ in range(1_500_000))
    rows = [(1, long), (2, long + " end"), (3, "a b c d e f"), (4, long[: len(long) // 2])]
    got = {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_near_duplicates_at_80(spark, monkeypatch):
    monkeypatch.setattr(nd, "REGION", 8)
    words = [f"w{i}" for i in range(40)]
    rows = [(10 * n + more, " ".join(words[n * 11 % 20 :][: n + 4 + more])) for n in (3, 4, 5, 6, 8) for more in (0, 1)]  # n and n + 1 shingles
    rows = [(i, " ".join(f"{w}x{i // 10}" for w in t.split())) for i, t in rows]
    rng = random.Random(3)
    base = [f"b{i}" for i in range(104)]
    for i in range(100, 140):  # a crowded group around 80
        w = list(base)
        for k in rng.sample(range(10, 95), rng.randint(1, 3)):
            w[k] = f"c{rng.randint(0, 9)}"
        rows.append((i, " ".join(w)))
    want = brute(rows, 80)
    assert {(41, 40), (51, 50), (31, 31)} <= {(i, c) for i, _, c, _ in want}
    out = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80).collect()
    assert sorted(map(tuple, out), key=str) == want
    for percent in (80, 85, 90):
        assert (1 - (percent / 100) ** nd.DEPTH) ** nd.forest_size(percent) <= 1e-5


def test_crowded_regions_lie_in_their_trees_order(spark, monkeypatch):
    tables = {}
    kept = nd.written
    monkeypatch.setattr(nd, "written", lambda df, what, *a: tables.setdefault(what, kept(df, what, *a)))
    rows = [(i, " ".join([*(f"w{k}" for k in range(99)), f"x{i}"])) for i in range(nd.REGION + 8)]
    nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    heads = {r["id"]: list(r["keys"]) for r in tables["heads"].collect()}
    signature = {r["id"]: np.frombuffer(r["sig"], np.uint16) for r in tables["heads"].collect()}
    seen = set()
    for r in tables["crowded"].collect():
        tree = heads[r["id"]].index(r["key"])
        seen.add(tree)
        assert np.frombuffer(r["sig"], np.uint16).tolist() == np.roll(signature[r["id"]], -nd.DEEPEST * tree).tolist()
    assert len(seen) > 1


@pytest.mark.parametrize("text", ["one", "one two", "one two three", "one two three four"])
def test_few_words_alone_in_a_chunk(spark, text):
    rows = [(1, text)]
    assert sorted(map(tuple, nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str) == brute(rows)
    rows = [(1, text), (2, "a b c d e f g"), (3, text.upper())]  # a partition of each
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3), "doc_id long, text string")
    assert sorted(map(tuple, nd.near_duplicates(docs).collect()), key=str) == brute(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_rounds_of_components_read_less_and_less(spark, monkeypatch):
    tables = []
    kept = components_module.written
    monkeypatch.setattr(components_module, "written", lambda df, what, *a: tables.append((what, kept(df, what, *a))) or tables[-1][1])
    rng = random.Random(9)
    nodes = [10 * i for i in range(1000)]
    edges = list(zip(nodes, nodes[1:], strict=False))  # a chain, a dense group and a random tree
    edges += [(10**6 + rng.randrange(100), 10**6 + rng.randrange(100)) for _ in range(1500)]
    edges += [(2 * 10**6 + rng.randrange(i), 2 * 10**6 + i) for i in range(1, 800)]
    f = Forest()
    for a, b in edges:
        f.join(a, b)
    want = {x: f.find(x) for e in edges for x in e if e[0] != e[1]}
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert sum(t.count() for what, t in tables if what in ("edges", "labels")) < 4 * (len(want) + len(set(edges)))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_common_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 50, rng.integers(1, 30)).astype(np.uint64)) for _ in range(20)]
    got = nd.common_counts(sets[:8], sets[8:], slab=7)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[8:]] for a in sets[:8]]


def test_merge_keeps_common_prefixes():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 7):
        runs = [sorted(bytes(rng.choices(b"ab", k=rng.randint(0, 9))) for _ in range(rng.randint(0, 30))) for _ in range(k)]
        out = list(merged([decoded(front_coded(r)) for r in runs]))
        assert [(x, i) for x, _, i in out] == sorted((x, i) for i, r in enumerate(runs) for x in r)
        last = b""
        for x, n, _ in out:
            assert n == common(last, x) and x[:n] == last[:n] and (n == min(len(x), len(last)) or x[n] != last[n])
            last = x


def repeats_brute(rows):
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for t in texts:
        for p in range(len(t) - sd.LENGTH + 1):
            seen[t[p : p + sd.LENGTH]] = seen.get(t[p : p + sd.LENGTH], 0) + 1
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 2, bool)
        for p in range(len(t) - sd.LENGTH + 1):
            if seen[t[p : p + sd.LENGTH]] > 1:
                gone[p + 1 : p + 1 + sd.LENGTH] = True
        left = bytes(b for b, g in zip(t, gone[1:], strict=False) if not g)
        out.append((i, len(t), len(t) - len(left), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [sd.HOT, 3])
def test_repeats_against_brute_force(spark, hot):
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choices("abc é", k=n))
    passage, other = noise(450), noise(199)
    rows = [(1, noise(300) + passage + noise(90)), (2, passage[100:] + noise(500)), (3, noise(40) + passage[:260]), (4, "ab" * 400), (5, "x" * 199), (6, "x" * 200), (7, "y" * 201), (8, None), (9, ""), (10, other), (11, other), (12, passage), (12, passage), (13, noise(2000)), (14, noise(100) + passage[200:420] + noise(3) + passage[200:420])]
    rows += [(20 + i, noise(rng.randint(0, 60)) + passage + noise(rng.randint(0, 60))) for i in range(12)]
    out = sd.remove_repeats(spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], SCHEMA), hot=hot).collect()
    assert sorted((tuple(r)[:5] for r in out), key=str) == repeats_brute(rows)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in out)
    assert sd.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(8)
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array(["".join(rng.choices("ab ", k=5000))])], names=["k", "text"])

    def windows():
        out = {}
        for b in sd._find(iter([batch])):
            for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                place, first, last = p >> 16, p >> 8 & 255, p & 255
                for w in range(place - first, place - last + 1):
                    out.setdefault(w, []).append((h, place))
        return out

    whole = windows()
    monkeypatch.setattr(sd, "PIECE", 333)
    assert windows() == whole and set(whole) == set(range(5000 - sd.LENGTH + 1)) and all(len(x) == 1 for x in whole.values())

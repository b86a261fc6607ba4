import itertools

import numpy as np
import pyarrow as pa
import pytest

from lemmata.llm import quality_crf as crf
from lemmata.llm import toxicity as tox
from lemmata.llm.labelled import fold

DATA = "/root/testdata/sf0.1"


def auc(y, s):
    order = np.argsort(np.argsort(s, kind="stable"))
    y = np.asarray(y)
    return (order[y == 1].mean() - (y == 1).sum() / 2 + 0.5) / (y == 0).sum()


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(1)
    lines = np.array([1, 4, 2, 5])
    odds, step = rng.normal(size=lines.sum()), rng.normal(size=(2, 2))
    marginal, pairs, _ = crf.forward_backward(odds, step, lines)
    want, want_pairs, at = [], np.zeros((2, 2)), 0
    for n in lines:
        total, m, p = 0.0, np.zeros(n), np.zeros((2, 2))
        for ys in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(odds[at + i] * y for i, y in enumerate(ys)) + sum(step[a, b] for a, b in zip(ys, ys[1:], strict=False)))
            total += w
            m += w * np.array(ys)
            for a, b in zip(ys, ys[1:], strict=False):
                p[a, b] += w
        want += list(m / total)
        want_pairs += p / total
        at += n
    assert marginal == pytest.approx(want) and pairs == pytest.approx(want_pairs)


def test_line_features_do_not_depend_on_batches():
    texts = [None, "", "\n", "a\n\nb b", "AB!! CD!!\nAB!! CD!!", "é x\ny", "\n\nz"]
    field = crf.Field(np.linspace(-1, 1, 3 * crf.N_OWN), np.array([[0.5, -0.5], [-0.2, 0.3]]), np.array([1.0, 0.5, 0.1]))
    together = crf.scores(field, pa.array(texts))
    alone = [crf.scores(field, pa.array([t], pa.string()))[0] for t in texts]
    assert together == pytest.approx(alone)
    x, size, lines = crf.line_features(np.frombuffer(b"a\n\nb b", np.uint8), np.array([0, 6]))
    assert (lines.tolist(), size.tolist()) == ([3], [1, 0, 3])


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    out = {r["doc_id"]: r for r in crf.op8_quality(spark, DATA).collect()}
    assert len(out) == docs.count()
    held = [(r["quality"], out[r["doc_id"]]) for r in labels.where(fold(labels["doc_id"], 5) == 0).collect()]
    assert all(o["held_out"] for _, o in held)
    assert auc([y for y, _ in held], [o["score"] for _, o in held]) > 0.98
    assert np.mean([y == o["predicted"] for y, o in held]) > 0.95
    toxic = {r["doc_id"]: r for r in tox.op5_toxicity(spark, DATA).collect()}
    held = [(r["toxic"], toxic[r["doc_id"]]) for r in labels.where(fold(labels["doc_id"], 4) == 2).collect()]
    assert auc([y for y, _ in held], [o["score"] for _, o in held]) > 0.85
    assert np.mean([y == o["predicted"] for y, o in held]) > 0.93


def test_edges_of_both(spark):
    schema = "doc_id long, text string, score int"
    rows = [(1, None, 1), (2, "", 1), (3, "idiot", 1), (3, "idiot", 1), (None, "x y", 1)]
    docs = spark.createDataFrame(rows, schema)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    field = crf.fitted(docs, none, lambda d: fold(d, 5) != 0)
    out = crf.classify(docs, field).collect()
    assert len(out) == 5 and {r["score"] for r in out} == {0.5}
    lexicon = tox.learned(docs, none, lambda d: fold(d, 4) != 2)
    out = tox.score_toxicity(docs, lexicon).collect()
    assert len(out) == 5 and {r["score"] for r in out} == {0.5}
    assert crf.classify(docs.limit(0), field).count() == tox.score_toxicity(docs.limit(0), lexicon).count() == 0


def test_folding_and_exceptions():
    assert tox.folded("ІdІ0t, $tup1d!") == " idiot stupid "
    assert tox.folded(None) == "  " and tox.folded("chón Straße") == " chón straße "
    a = tox.Lexicon({"trash ": 3.0, "lowei": 2.0}, ("trash can",)).automaton()
    assert tox.evidence(tox.folded("tr4sh"), a)[2] == 3.0
    assert tox.evidence(tox.folded("the trash can"), a)[2] == 0.0
    assert tox.evidence(tox.folded("trashed loweien"), a)[2] == 2.0
    assert tox.evidence(tox.folded(""), a)[0] == 0.0


def test_field_is_fitted_on_whole_documents(spark, monkeypatch):
    lines = []
    monkeypatch.setattr(crf, "fit", lambda x, size, n, y: lines.append(sorted(n.tolist())))
    docs = spark.createDataFrame([(1, "a b\n" * 299 + "end"), (2, "one"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, quality int")
    crf.fitted(docs, labels, lambda d: d > 0)
    monkeypatch.setattr(crf, "TRAIN_LINES", 299)
    crf.fitted(docs, labels, lambda d: d > 0)
    assert lines == [[1, 1, 300], [1, 1]]


def test_lines_of_mixed_documents(spark):
    """Held-out bad documents inside held-out good ones: their lines, and only theirs, come out bad."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    field = crf.fitted(docs, labels, lambda d: fold(d, 5) != 0)
    rows = docs.join(labels, "doc_id").where(fold(docs["doc_id"], 5) == 0).orderBy("doc_id").collect()
    good = [r["text"].split("\n") for r in rows if r["quality"] == 1 and "\n" in r["text"]]
    bad = [r["text"].split("\n") for r in rows if r["quality"] == 0 and r["text"].strip()]
    texts, want = [], []
    for g, b in zip(good, bad, strict=False):
        k = len(g) // 2
        texts.append("\n".join([*g[:k], *b, *g[k:]]))
        want.append([1] * k + [0] * len(b) + [1] * (len(g) - k))
    out = crf.classify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), field, bad_lines="bad_lines").orderBy("doc_id").collect()
    got = [[int(i not in r["bad_lines"]) for i in range(len(w))] for r, w in zip(out, want, strict=True)]
    assert np.mean([np.mean(np.array(g) == w) for g, w in zip(got, want, strict=True)]) > 0.85
    g, w = np.concatenate(got), np.concatenate(want)
    print("bad lines found", (g[w == 0] == 0).mean(), "good lines left", (g[w == 1] == 1).mean())
    assert (g[w == 0] == 0).mean() > 0.5 and (g[w == 1] == 1).mean() > 0.95


def test_spliced_documents():
    rng = np.random.default_rng(5)
    lines, y = np.array([2, 3, 1]), np.array([1, 0, 0])
    own = rng.normal(size=(6, crf.N_OWN)).astype(np.float32)
    x, count, label = crf.spliced(crf.in_context(own, np.repeat(np.arange(3), lines)), lines, y, 9)
    assert count.tolist() == [5, 3] and label.tolist() == [0, 0, 1, 1, 0, 1, 0, 1]
    assert (x[:, : crf.N_OWN] == own[[2, 3, 0, 1, 4, 0, 5, 1]]).all()
    assert (x[1, crf.N_OWN : 2 * crf.N_OWN] == own[2]).all() and not x[4, 2 * crf.N_OWN :].any()
    assert crf.spliced(x, lines, np.array([1, 1, 1]), 9)[1].tolist() == []


def test_texts_of_ten_megabytes():
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(500)]
    text = "\n".join(" ".join(rng.choice(words, 10)) for _ in range(280_000))
    field = crf.Field(np.linspace(-1, 1, 3 * crf.N_OWN), np.zeros((2, 2)), np.array([1.0, 0.5, 0.1]))
    (score, lines, marginal), = crf.line_marginals(field, pa.array([text]))
    assert 0 <= score[0] <= 1 and lines.tolist() == [280_000] == [len(marginal)]
    a = tox.Lexicon({"w499 ": 3.0}).automaton()
    assert tox.evidence(tox.folded(text.replace("w", "w" * 2)), a)[0] == 0.0 and tox.evidence(tox.folded(text.replace("w499", "x")), a)[3] > 14


def plain_evidence(text, entries, exceptions):
    """As ``tox.evidence``: every entry tried at every place."""
    best = {}
    for i, c in enumerate(text):
        if c == " ":
            for e, w in entries.items():
                if text.startswith(" " + e, i):
                    best[i] = max(best.get(i, -9.0), w)
    for e in exceptions:
        for i in range(len(text)):
            if text.startswith(f" {e} ", i):
                best = {s: w for s, w in best.items() if not i <= s < i + len(e) + 1}
    n = text.count(" ")
    total = sum(w for _, w in sorted(best.items()))
    return total / (1 + np.log1p(n)), min(total / n * 10, 5), max(best.values(), default=0.0), np.log1p(n)


def test_matching_against_every_entry_at_every_place():
    rng = np.random.default_rng(7)
    words = ["ab", "abc", "abcd", "b", "bc", "c d", "x", "ba"]
    for _ in range(300):
        entries = {str(w) + rng.choice(["", " "]): float(rng.uniform(0.5, 4)) for w in rng.choice(words[:5] + ["x", "ba"], rng.integers(0, 5))}
        exceptions = tuple(" ".join(rng.choice(["ab", "bc", "x", "abc"], rng.integers(1, 4))) for _ in range(rng.integers(0, 4)))
        text = tox.folded(" ".join(rng.choice(["ab", "abc", "bc", "x", "4b", "Xy", "abcde", "ba"], rng.integers(0, 25))))
        assert tox.evidence(text, tox.Lexicon(entries, exceptions).automaton()) == pytest.approx(plain_evidence(text, entries, exceptions))


def test_weights_against_plain_counts(spark):
    rows = [(i, "vile words here" if i % 3 == 0 else "good words here" if i % 3 == 1 else "a vile plant here", int(i % 3 == 0)) for i in range(90)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    lexicon = tox.learned(docs, labels, lambda d: d >= 0)
    toxic, other = 30, 60
    for e, w in lexicon.entries.items():
        holds = lambda t: any((x + " ").startswith(e) for x in t.split())  # noqa: B023, E731
        p, n = sum(holds(t) for _, t, y in rows if y), sum(holds(t) for _, t, _ in rows)
        assert w == pytest.approx(np.log((p + 0.5) / (toxic + 1)) - np.log((n - p + 0.5) / (other + 1)))
    assert lexicon.exceptions == () or all("vile" in e for e in lexicon.exceptions)
    same = docs.withColumn("text", docs["doc_id"].cast("string"))
    assert tox.learned(same, labels, lambda d: d >= 0).entries == {}  # no entry is found, and nothing fails
    assert tox.score_toxicity(docs, tox.learned(same, labels, lambda d: d >= 0)).count() == 90

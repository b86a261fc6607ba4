import random
from collections import Counter

from lemmata.llm import quality_rules as quality_rules_module
from lemmata.llm.quality_rules import GOOD, accuracy, fit, posterior, quality_rules, with_statistics

SCHEMA = "doc_id long, text string, extra string"


def brute(text):
    t = text or ""
    words = [w for w in t.translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def both_ways(docs):
    for long in (quality_rules_module.LONG, 40, -1):
        yield {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in with_statistics(docs, long).collect()}, {tuple(r[c] for c in ("doc_id", *quality_rules_module.STATISTICS)) for r in with_statistics(docs, long).collect()}


def test_statistics_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quality_rules_module, "PIECE", 7)
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a", "a b", "a a a", "a a a a", "a b c a b c", "x\n x\nx\n\nx", "é| é| z #", "a b c a b c d", "w " * 3000, "longword" * 9, "\U0001f600! Ab\n" * 5]
    texts += ["".join(rng.choice(["a", "bb", "c*", " ", " ", "\n", "\t"]) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    rows = [(i, t, "e") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    results = list(both_ways(docs))
    assert all(got == {i: brute(t) for i, t, _ in rows} for got, _ in results)
    assert all(everything == results[0][1] for _, everything in results)


def test_text_of_ten_megabytes(spark):
    rng = random.Random(3)
    text = " ".join(rng.choice(["ab", "cde", "f*", "\n", "ghij"]) + str(rng.randint(0, 200)) for _ in range(1_500_000))
    docs = spark.createDataFrame([(1, text, ""), (2, "a b c d", ""), (2, "a b c d", "")], "doc_id long, text string, _long string")
    out = with_statistics(docs).collect()
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in out}
    assert len(out) == 3 and got == {1: brute(text), 2: brute("a b c d")}


def test_verdicts(spark):
    rng = random.Random(2)
    prose = lambda: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(3, 8))) for _ in range(80)) + ". It ends here, well."
    junk = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) + "***" for _ in range(80))
    rows = [(i, prose(), "") for i in range(60)] + [(100 + i, junk(), "") for i in range(10)] + [(200, "short", ""), (200, "short", ""), (201, None, "")]
    out = quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()
    kept = {r["doc_id"]: r["kept"] for r in out}
    assert len(out) == len(rows)
    assert all(kept[i] for i in range(60)) and not any(kept[i] for i in kept if i >= 100)
    assert all(r["base_failed"] == (r["n_words"] < 50) for r in out)
    assert quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0


def test_estimated_accuracies():
    opinions = [-1, -1, 1]
    patterns = [((0, 0, 1), 900), ((-1, -1, 0), 80), ((-1, 0, 1), 15), ((0, -1, 0), 5)]
    share, rates = fit(patterns, opinions)
    assert 0.85 < share < 0.95
    assert all(accuracy(o, r, share) > 0.7 for o, r in zip(opinions, rates, strict=True))
    assert posterior((0, 0, GOOD), rates, share) > 0.9 > 0.1 > posterior((-1, -1, 0), rates, share)
    assert fit([], opinions)[0] == 0.8

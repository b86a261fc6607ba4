"""Toxicity from a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, maps look-alike letters of other scripts and digits or
signs used as letters to Latin letters, and leaves single spaces between words. The lexicon holds whole words and beginnings of words; their
weights are log-ratios of how many toxic and other labelled documents hold
them. Exception phrases, found in labelled rows that are not toxic or given,
cancel the entries inside them. The weights found in a text, normalised by its
length, go through a logistic curve fitted on the same labelled rows.

Learning reads ``TRAIN_ROWS`` labelled rows at most, of ``TRAIN_CHARACTERS`` in
all at most, as whole rows; all entries that they show to be significant, and
all phrases, reach the driver. These are bounded by the sample: an entry needs
several toxic documents.

Defined results: a null or empty text holds no entry and gets the score of
that; repeated rows each get their own (equal) result; other columns go along;
an empty table gives an empty result; without labels, or without any entry
found in them, every score is that of the curve alone, 0.5 without labels. A
text of any length is folded as one string, and takes a few bytes for each
character.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fitting, mapped, table, trimming, written
from .labelled import fold, logistic, sample

TRAIN_ROWS, TRAIN_CHARACTERS = 20_000, 200_000_000
#: Beginnings of words are tried in these lengths.
STEMS = (4, 5, 6)
#: An entry's least log-ratio, and the least surprise at its share of toxic
#: documents: twice the log-likelihood ratio against the common share.
LEAST_WEIGHT, LEAST_SURPRISE = 1.5, 14.0
#: Letters that look like Latin ones, and digits and signs used for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ɡ": "g", "ı": "i", "ℓ": "l",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}


class _Folds(dict):
    """Translation of code points, worked out when first seen."""

    def __missing__(self, code: int):
        c = unicodedata.normalize("NFKC", chr(code)).lower()
        c = "".join(HOMOGLYPHS.get(x) or DIGITS.get(x) or x for x in c)
        if not c.isalpha():
            c = "" if unicodedata.category(chr(code)) in ("Cf", "Mn") else " "
        self[code] = c
        return c


_FOLDS = _Folds()


def folded(text: str | None) -> str:
    """Words of lower-case letters, single spaces between, before and after."""
    return f" {' '.join((text or '').translate(_FOLDS).split())} "


@dataclass
class Lexicon:
    """Weights by entry; an entry that ends in a space is a whole word."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, ...] = (0.0,) * 5

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for e, w in self.entries.items():
            a.add_word(" " + e, (len(e) + 1, w))
        for e in self.exceptions:
            a.add_word(f" {e} ", (len(e) + 2, None))
        a.make_automaton()
        return a


def evidence(text: str, automaton) -> tuple[float, float, float, float]:
    """Of a folded text: sum of the words' best weights by the logarithm of
    the length and by the length, the highest weight, and the length."""
    best: dict[int, float] = {}
    spared = []
    for end, (n, w) in automaton.iter(text) if len(automaton) else ():
        start = end - n + 1
        if w is None:
            spared.append((start, end))
        elif w > best.get(start, -9.0):
            best[start] = w
    if spared:
        starts = [a for a, _ in sorted(spared)]
        ends = list(accumulate((b for _, b in sorted(spared)), max))
        best = {s: w for s, w in best.items() if not (i := bisect_right(starts, s)) or s >= ends[i - 1]}
    n = text.count(" ")
    total = sum(best.values())
    return total / (1 + math.log1p(n)), min(total / n * 10, 5), max(best.values(), default=0.0), math.log1p(n)


@trimming
def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found = set(folded(t).split())
            grams = {w + " " for w in found} | {w[:k] for w in found for k in STEMS if len(w) >= k}
            yield pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), pa.array([y] * len(grams), pa.int32())], names=["gram", "y"])


def learned(docs: DataFrame, labels: DataFrame, keep, rows: int = TRAIN_ROWS, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Lexicon and curve from at most ``rows`` labelled rows that ``keep`` allows."""
    found = written(sample(docs, labels, "toxic", rows, keep), "labelled-toxic")
    found = fitting(found, "doc_id", F.coalesce(F.length("text"), F.lit(0)), TRAIN_CHARACTERS).select("text", "y")
    totals = {r["y"]: r["count"] for r in found.groupBy("y").count().collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        return Lexicon()
    counted = found.mapInArrow(_grams, "gram string, y int").groupBy("gram").agg(F.sum("y").alias("p"), F.count("*").alias("n"))
    weight = F.log((F.col("p") + 0.5) / (pos + 1)) - F.log((F.col("n") - F.col("p") + 0.5) / (neg + 1))
    p, n, share = F.col("p"), F.col("n"), pos / (pos + neg)
    surprise = 2 * (p * F.log(p / n / share) + F.when(n > p, (n - p) * F.log((n - p) / n / (1 - share))).otherwise(0.0))
    kept = counted.where(p > 0).withColumn("w", weight).where((F.col("w") >= LEAST_WEIGHT) & (surprise >= LEAST_SURPRISE))
    top = kept.orderBy("gram").collect()  # bounded by the sample
    lexicon = Lexicon({r["gram"]: r["w"] for r in top}, tuple(exceptions))
    lexicon.exceptions += _phrases(found, lexicon)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def measure(batches):
        a = shared.value.automaton()
        for b in batches:
            e = [evidence(folded(t), a) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in e], pa.float64()) for i in range(4)] + [b.column(1)], names=["a", "b", "c", "d", "y"])

    x = np.array(sorted(map(tuple, found.mapInArrow(measure, "a double, b double, c double, d double, y int").collect())))
    lexicon.curve = tuple(logistic(x[:, :4], x[:, 4]))
    return lexicon


def _phrases(found: DataFrame, lexicon: Lexicon, least: int = 5) -> tuple[str, ...]:
    """Two-word phrases around an entry that ``least`` labelled documents hold,
    none of them toxic."""
    if not lexicon.entries:
        return ()
    shared = found.sparkSession.sparkContext.broadcast(lexicon)

    def pairs(batches):
        a = shared.value.automaton()
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t, out = folded(t), set()
                for end, (n, _) in a.iter(t):
                    s = end - n + 1
                    stop = t.find(" ", s + 1)
                    before, after = t.rfind(" ", 0, max(s, 0)), t.find(" ", stop + 1)
                    if before >= 0:
                        out.add(t[before + 1 : stop])
                    if after >= 0:
                        out.add(t[s + 1 : after])
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array([y] * len(out), pa.int32())], names=["phrase", "y"])

    counted = found.mapInArrow(pairs, "phrase string, y int").groupBy("phrase").agg(F.sum("y").alias("p"), F.count("*").alias("n"))
    return tuple(r["phrase"] for r in counted.where((F.col("p") == 0) & (F.col("n") >= least)).orderBy("phrase").collect())


def score_toxicity(docs: DataFrame, lexicon: Lexicon, column: str = "score") -> DataFrame:
    """``docs`` with ``column``, the probability that toxic is 1; a column of that
    name is replaced."""
    docs = docs.drop(column)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # bounded by the sample that it was learned on
    at = docs.columns.index("text")

    @trimming
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, curve = shared.value.automaton(), np.array(shared.value.curve)
        for b in batches:
            e = np.array([evidence(folded(t), a) for t in b.column(at).to_pylist()]).reshape(-1, 4)
            s = 1 / (1 + np.exp(-np.clip(e @ curve[:-1] + curve[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], names=[*b.schema.names, f"c{b.num_columns}"])

    return mapped(docs, run, docs.select("*", F.lit(0.0).alias(column)).schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = learned(docs, labels, lambda d: fold(d, 4) != 2)
    return score_toxicity(docs.select("doc_id", "text"), lexicon).select(
        "doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )

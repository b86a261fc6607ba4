"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are counts on the line itself and on
the lines before and after it. Which lines are good is not known: a line's true
label is latent, and its document's label is a reading of it that is wrong as
often as ``WRONG`` says, so that a junk line in a good document may well come
out bad. The field is trained on the likelihood of these readings, over the
labelled documents and over ones spliced of a good and a bad document each,
which hold the steps between good and bad that whole documents seldom show. The
marginals that forward-backward gives are averaged with the lines' lengths as
weights, and a logistic curve fitted on the labelled documents turns that, with
the mean evidence of the lines, into the score.

Training takes whole texts, of ``TRAIN_ROWS`` labelled rows at most and of fewer
where their lines would exceed ``TRAIN_LINES`` in all; a row of more lines than
that is not chosen.

Defined results: a null or empty text is one empty line and gets a score;
repeated rows each get their own (equal) result; other columns go along; an
empty table gives an empty result; without labels every score is 0.5. A text of
any length is one chain: about 200 bytes for each of its lines and 60 for each
of its words are held at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fitting, mapped, table, trimming, written
from .labelled import fold, logistic, sample
from .textbytes import LOWER_VALUES, chunks, prefix_hashes, span_hashes, words

TRAIN_ROWS, TRAIN_LINES = 6000, 120_000
_CLASS = np.zeros(256, np.uint8)  # 1 upper, 2 symbol, 3 shout, 4 digit, 5 stop, 6 bar
for _k, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "#*$%&<>", "!?", "0123456789", ".,;:", "|"), 1):
    _CLASS[[ord(c) for c in _chars]] = _k
N_OWN = 14
#: How often a bad line is taken for good as its document is, and a good one for bad.
WRONG = (0.15, 0.15)


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their lengths in bytes, and lines in each row."""
    new = np.flatnonzero(data == 10) + 1
    # the bytes that begin lines, empty texts and lines included
    begins = np.sort(np.concatenate([offsets[:-1], new]), kind="stable")
    row = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, new - 1, "right") - 1])
    at = np.concatenate([offsets[:-1], new])
    order = np.lexsort((at, row))
    begins, row = at[order], row[order]
    n = len(begins)
    lines = np.bincount(row, minlength=len(offsets) - 1)
    ends = np.append(begins[1:], len(data))
    last = np.append(row[1:] != row[:-1], True)
    ends = np.where(last, offsets[row + 1], ends - 1)
    size = ends - begins
    counts = np.zeros((n, 7))
    kind = _CLASS[data]
    for k in range(1, 7):
        total = np.concatenate([[0], np.cumsum(kind == k)])
        counts[:, k] = total[ends] - total[begins]
    start, end, _ = words(data, offsets)
    line = np.searchsorted(begins, start, "right") - 1
    hashes = span_hashes(prefix_hashes(data, LOWER_VALUES), start, end) if len(start) else np.zeros(0, np.uint64)
    n_words = np.bincount(line, minlength=n)
    by = np.lexsort((hashes, line))
    fresh = np.ones(len(by), bool)
    fresh[1:] = (hashes[by][1:] != hashes[by][:-1]) | (line[by][1:] != line[by][:-1])
    distinct = np.bincount(line[by][fresh], minlength=n)
    again = np.zeros(len(start))
    again[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    adjacent = np.bincount(line, again, minlength=n)
    letters = np.bincount(line, end - start, minlength=n)
    # lines equal to an earlier one of their text
    content = np.zeros(n, np.uint64)
    np.add.at(content, line, hashes * (2 * (np.arange(len(hashes)) - np.concatenate([[0], np.cumsum(n_words)])[line]) + 1).astype(np.uint64))
    by = np.lexsort((np.arange(n), content, row))
    dup = np.zeros(n)
    dup[by[1:]] = (content[by][1:] == content[by][:-1]) & (row[by][1:] == row[by][:-1]) & (n_words[by][1:] > 0)
    w, c = np.maximum(n_words, 1), np.maximum(letters, 1)
    own = np.column_stack([
        np.ones(n), np.log1p(size) / 5, np.log1p(n_words) / 3, np.minimum(letters / w, 20) / 10,
        counts[:, 1] / c, counts[:, 1] / c > 0.5, np.minimum(counts[:, 2] / w, 4), counts[:, 2] / w > 0.3,
        np.minimum(counts[:, 3] / w, 3), counts[:, 4] / c, np.minimum(counts[:, 6] / w, 2),
        1 - distinct / w, adjacent / w, dup,
    ]).astype(np.float32)
    return in_context(own, row), size, lines


def in_context(own: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Features of each line, of the one before and of the one after in its text."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    same = row[1:] == row[:-1]
    before[1:][same] = own[:-1][same]
    after[:-1][same] = own[1:][same]
    return np.column_stack([own, before, after])


@dataclass
class Field:
    """Weights of the field and of the curve behind it."""

    unary: np.ndarray  # log-odds of good by feature
    step: np.ndarray  # 2 x 2, from bad/good to bad/good
    curve: np.ndarray


def forward_backward(odds: np.ndarray, step: np.ndarray, lines: np.ndarray):
    """Marginals of good, expected transitions and log-partition sums of chains
    that lie one after the other in ``odds``; state 0 is bad and scores 0."""
    start = np.concatenate([[0], np.cumsum(lines)[:-1]])
    order = np.argsort(-lines, kind="stable")
    start, longest = start[order], int(lines.max(initial=0))
    active = np.searchsorted(-lines[order], -np.arange(longest), "left")  # chains longer than t
    unary = np.column_stack([np.zeros(len(odds)), odds])
    a, b = np.zeros_like(unary), np.zeros_like(unary)
    for t in range(longest):
        i = start[: active[t]] + t
        a[i] = unary[i] if not t else unary[i] + np.logaddexp(a[i - 1, :1] + step[0], a[i - 1, 1:] + step[1])
    for t in range(longest - 2, -1, -1):
        i = start[: active[t + 1]] + t
        x = unary[i + 1] + b[i + 1]
        b[i] = np.logaddexp(step[:, 0] + x[:, :1], step[:, 1] + x[:, 1:])
    both = a + b
    z = np.logaddexp(both[:, 0], both[:, 1])
    first = np.zeros(len(odds), bool)
    first[start] = True
    j = np.flatnonzero(~first)
    pairs = np.zeros((2, 2))
    for p in (0, 1):
        for q in (0, 1):
            pairs[p, q] = np.exp(a[j - 1, p] + step[p, q] + unary[j, q] + b[j, q] - z[j]).sum()
    return np.exp(both[:, 1] - z), pairs, z


def summary(odds: np.ndarray, marginal: np.ndarray, size: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """For each text: log-odds of its length-weighted mean marginal, and the
    length-weighted mean of its lines' own evidence."""
    at = np.concatenate([[0], np.cumsum(lines)[:-1]])
    weight = size + 1.0
    total = np.add.reduceat(weight, at)
    m = np.clip(np.add.reduceat(weight * marginal, at) / total, 1e-4, 1 - 1e-4)
    return np.column_stack([np.log(m / (1 - m)), np.clip(np.add.reduceat(weight * odds, at) / total, -10, 10)])


def spliced(features: np.ndarray, lines: np.ndarray, y: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, lines in each row and labels of lines of documents made of two:
    one inserted in the middle of the other, good and bad in turn, of ``most``
    lines in all at most."""
    end = np.cumsum(lines)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    own, count, label = [], [], []
    for i in range(max(len(good), len(bad)) if len(good) and len(bad) else 0):
        outer, inner = (good[i % len(good)], bad[i % len(bad)])[:: 1 if i % 2 else -1]
        if sum(count) + lines[outer] + lines[inner] > most:
            break
        middle = end[outer] - lines[outer] // 2
        at = np.concatenate([np.arange(end[outer] - lines[outer], middle), np.arange(end[inner] - lines[inner], end[inner]), np.arange(middle, end[outer])])
        own.append(features[at, :N_OWN])
        count.append(len(at))
        label.append(np.where((at >= end[inner] - lines[inner]) & (at < end[inner]), y[inner], y[outer]))
    if not own:
        return features[:0], lines[:0], y[:0]
    return in_context(np.concatenate(own), np.repeat(np.arange(len(count)), count)), np.array(count), np.concatenate(label)


def fit(features: np.ndarray, size: np.ndarray, lines: np.ndarray, y: np.ndarray, rounds: int = 100) -> Field:
    """Penalised maximum likelihood of the readings by Adam, then the curve.
    The gradient is what the field expects given the readings, less what it
    expects without them."""
    if not len(y) or y.min() == y.max():
        return Field(np.zeros(features.shape[1]), np.zeros((2, 2)), np.array([0.0, 0.0, 0.0]))
    more, count, label = spliced(features, lines, y, TRAIN_LINES // 2)
    x, chains = np.concatenate([features, more]), np.concatenate([lines, count])
    label = np.concatenate([np.repeat(y, lines), label])
    reading = np.where(label == 1, np.log((1 - WRONG[1]) / WRONG[0]), np.log(WRONG[1] / (1 - WRONG[0])))
    theta, m, v = np.zeros(x.shape[1] + 4), 0.0, 0.0
    for r in range(1, rounds + 1):
        odds, step = x @ theta[:-4], theta[-4:].reshape(2, 2)
        known, held, _ = forward_backward(odds + reading, step, chains)
        free, pairs, _ = forward_backward(odds, step, chains)
        g = np.concatenate([x.T @ (known - free), (held - pairs).ravel()]) / len(label) - 1e-3 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + 0.1 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    odds, step = features @ theta[:-4], theta[-4:].reshape(2, 2)
    marginal, _, _ = forward_backward(odds, step, lines)
    return Field(theta[:-4], step, logistic(summary(odds, marginal, size, lines), y))


def line_marginals(field: Field, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of run after run of ``texts``: scores, lines in each, and the probability
    of each line to be good."""
    for _, data, offsets in chunks(texts):
        x, size, lines = line_features(data, offsets)
        odds = x @ field.unary
        marginal, _, _ = forward_backward(odds, field.step, lines)
        s = summary(odds, marginal, size, lines) @ field.curve[:-1] + field.curve[-1]
        yield 1 / (1 + np.exp(-np.clip(s, -30, 30))), lines, marginal


def scores(field: Field, texts: pa.Array) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(s for s, _, _ in line_marginals(field, texts))])


def fitted(docs: DataFrame, labels: DataFrame, keep, rows: int = TRAIN_ROWS) -> Field:
    """The field from at most ``rows`` labelled rows that ``keep`` allows, and
    ``TRAIN_LINES`` lines."""

    @trimming
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, data, offsets in chunks(b.column(0)):
                x, size, lines = line_features(data, offsets)
                end = np.cumsum(lines)
                for i, n in enumerate(lines):
                    s = slice(end[i] - n, end[i])
                    yield pa.RecordBatch.from_arrays([b.column(1)[at + i : at + i + 1], pa.array([x[s].tobytes()]), pa.array([size[s].tobytes()])], names=["y", "x", "size"])

    chosen = written(sample(docs, labels, "quality", rows, keep), "labelled")
    count = F.length("text") - F.length(F.translate("text", "\n", "")) + 1
    chosen = fitting(chosen, "doc_id", F.coalesce(count, F.lit(1)), TRAIN_LINES)
    found = chosen.select("text", "y").mapInArrow(features, "y int, x binary, size binary").collect()
    found.sort(key=lambda r: (r["y"], bytes(r["x"])))  # the sum's order, and so the fit, is always the same
    if not found:
        return fit(np.zeros((0, 3 * N_OWN)), np.zeros(0), np.zeros(0, int), np.zeros(0))
    size = [np.frombuffer(r["size"], np.int64) for r in found]
    x = np.concatenate([np.frombuffer(r["x"], np.float32).reshape(-1, 3 * N_OWN) for r in found])
    return fit(x, np.concatenate(size), np.array([len(s) for s in size]), np.array([r["y"] for r in found]))


def classify(docs: DataFrame, field: Field, column: str = "score", bad_lines: str | None = None) -> DataFrame:
    """``docs`` with ``column``, the probability that quality is 1, and with
    ``bad_lines``, if it is named, the numbers from 0 of lines that are rather
    bad; columns of these names are replaced."""
    docs = docs.drop(column, *([bad_lines] if bad_lines else []))
    shared = docs.sparkSession.sparkContext.broadcast(field)  # a few hundred floats
    at = docs.columns.index("text")

    @trimming
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(line_marginals(shared.value, b.column(at)))
            more = [pa.array(np.concatenate([np.zeros(0), *(s for s, _, _ in found)]))]
            if bad_lines:
                lists = [np.flatnonzero(m < 0.5).astype(np.int32) for _, lines, marginal in found for m in np.split(marginal, np.cumsum(lines)[:-1])]
                more.append(pa.array(lists, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, *(f"c{b.num_columns + i}" for i in range(len(more)))])

    schema = docs.select("*", F.lit(0.0).alias(column), *([F.array(F.lit(0)).alias(bad_lines)] if bad_lines else [])).schema
    return mapped(docs, run, schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    field = fitted(docs, labels, lambda d: fold(d, 5) != 0)
    return classify(docs.select("doc_id", "text"), field, bad_lines="bad_lines").select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "bad_lines"
    )

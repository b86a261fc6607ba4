"""Secret scans: fixed patterns, plus character Markov models.

Two character models of second order, one of random strings and one of
ordinary identifiers and words, are trained from labelled samples: generated
keys and identifiers, and words of the corpus, which count as random where the
patterns take them for secrets and as ordinary elsewhere. A token of
``MIN_TOKEN`` characters or more whose log-likelihood ratio a character exceeds
``THRESHOLD`` is taken for a secret, kind ``random``. The patterns' spans
always stay; a token that lies within one of them is left out, and one that
only overlaps them is scored whole.

Defined results: a null or empty text has no spans; repeated rows each get
their own result; other columns go along or are ignored; an empty table gives an
empty result. A text of any length is scanned as one string.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fitting, hash_sample, mapped, table, trimming, written

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KINDS = ("assign", "access", "hex", "random")
MIN_TOKEN, THRESHOLD = 20, 1.0
#: Documents, by smallest hash of doc_id, whose words train the model of ordinary strings,
#: and how many words they hold in all at most.
TRAIN_DOCUMENTS, TRAIN_WORDS = 500, 2_000_000
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
ORDINARY = (
    "get set user name file path read write open close list index count value key map item node left right first last begin end "
    "http www com org net example config option default error message handler request response session client server table column "
    "row query result parse format string number integer float double boolean array object class method function static public "
    "private import export module package version update insert delete select create drop test check load save start stop"
).split()
_CODE = np.full(256, len(ALPHABET), np.int64)
for _i, _c in enumerate(ALPHABET):
    _CODE[ord(_c)] = _i
_N = len(ALPHABET) + 1  # the last stands for the start


def _codes(s: str) -> np.ndarray:
    return np.concatenate(([_N - 1, _N - 1], _CODE[np.frombuffer(s.encode("ascii", "replace"), np.uint8)]))


def counts(samples: Iterable[str]) -> np.ndarray:
    """Smoothed log-probabilities of a character after two others, backing off
    to one and to none."""
    c3, c2, c1 = np.zeros((_N, _N, _N)), np.zeros((_N, _N)), np.ones(_N)
    for s in samples:
        x = _codes(s)
        np.add.at(c3, (x[:-2], x[1:-1], x[2:]), 1)
        np.add.at(c2, (x[1:-1], x[2:]), 1)
        np.add.at(c1, x[2:], 1)
    p1 = c1 / c1.sum()
    p2 = (c2 + 4 * p1) / (c2.sum(1, keepdims=True) + 4)
    return np.log((c3 + 8 * p2) / (c3.sum(2, keepdims=True) + 8))


def random_samples(n: int = 6000, seed: int = 7) -> list[str]:
    """Strings labelled random: hex, base 64 and alphanumeric keys."""
    rng = np.random.default_rng(seed)
    sets = ["0123456789abcdef", ALPHABET[:62], ALPHABET[:64], "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", ALPHABET[:26] + "0123456789"]
    return ["".join(rng.choice(list(sets[i % len(sets)]), rng.integers(20, 64))) for i in range(n)]


def identifier_samples(n: int = 3000, seed: int = 8) -> list[str]:
    """Strings labelled ordinary: identifiers in the usual styles."""
    rng, out = np.random.default_rng(seed), []
    for i in range(n):
        w = list(rng.choice(ORDINARY, rng.integers(2, 6)))
        out.append(("_".join(w), "-".join(w), w[0] + "".join(map(str.capitalize, w[1:])), "/".join(w), "_".join(w).upper())[i % 5])
    return out


def ratio_model(ordinary_words: Iterable[str], secret_words: Iterable[str] = ()) -> np.ndarray:
    """Log-likelihood ratio, random over ordinary, of a character after two others."""
    words = [re.sub(r"[^A-Za-z0-9+/_=-]", "", w) for w in ordinary_words]
    joined = ["".join(words[i : i + 3]) for i in range(0, len(words), 3)]
    return (counts([*random_samples(), *secret_words]) - counts(identifier_samples() + words + joined)).astype(np.float32)


def score(token: str, model: np.ndarray) -> float:
    x = _codes(token)
    return float(model[x[:-2], x[1:-1], x[2:]].mean())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end), leftmost non-overlapping within each kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def all_spans(text: str, base: list, model: np.ndarray) -> list[tuple[int, int, int]]:
    out, at, reach = list(base), 0, -1
    for m in TOKEN.finditer(text):
        while at < len(base) and base[at][0] <= m.start():
            reach = max(reach, base[at][2])  # a span that starts before the token holds it if it reaches its end
            at += 1
        if m.end() > reach and score(m.group(), model) > THRESHOLD:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def fitted(docs: DataFrame) -> np.ndarray:
    """The ratio model, its words those of ``TRAIN_DOCUMENTS`` whole documents,
    labelled by the patterns; of fewer documents where their words would exceed
    ``TRAIN_WORDS``."""
    clean = hash_sample(docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text"), "doc_id", TRAIN_DOCUMENTS)
    split = F.split("text", r"[\x20\x09-\x0D]+")
    clean = fitting(written(clean, "ordinary"), "doc_id", F.size(split), TRAIN_WORDS)
    words = clean.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), "doc_id", "text").select(split.alias("w")).collect()
    found = [(w, base_spans(w)) for r in words for w in r["w"]]
    secret = [t for w, spans in found for s, _, e in spans for t in TOKEN.findall(w[s:e])]
    return ratio_model([w for w, spans in found if not spans], secret)


def scan_secrets(docs: DataFrame, model: np.ndarray | None = None) -> DataFrame:
    """Columns of ``docs`` that carry the row (``doc_id``, ``text``) with the
    digest of its spans and the text with every span replaced."""
    model = fitted(docs) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 67**3 floats

    @trimming
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                text = text or ""
                base = base_spans(text)
                spans = all_spans(text, base, shared.value)
                n = [sum(k == i for _, k, _ in base) for i in range(3)]
                rows.append((doc.as_py(), *n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), redacted(text, spans) if spans else None))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols[1:], [pa.int64()] * 3 + [pa.string()] * 3, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string")


def redacted(text: str, spans, mark: str = "[SECRET]") -> str:
    """``text`` with each maximal run of overlapping spans replaced by ``mark``."""
    out, at, end = [], 0, -1
    for s, _, e in spans:
        if s >= end:
            out += [text[at:s], mark]
        at = end = max(end, e)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, model: np.ndarray | None = None) -> DataFrame:
    """``docs`` with secrets replaced in ``text`` and ``n_chars`` renewed; all
    rows and columns stay."""
    model = fitted(docs) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, schema = docs.columns.index("text"), docs.schema
    n_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    @trimming
    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t if t is None else redacted(t, all_spans(t, base_spans(t), shared.value)) for t in b.column(at).to_pylist()]
            cols = list(b.columns)
            cols[at] = pa.array(texts, b.schema.field(at).type)
            if n_at is not None:
                cols[n_at] = pa.array([None if t is None else len(t) for t in texts], b.schema.field(n_at).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return mapped(docs, redact, schema)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents")).drop("redacted")

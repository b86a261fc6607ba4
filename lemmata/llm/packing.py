"""Cost-balanced packing of tokenized documents into training sequences.

A piece of ``n`` tokens costs ``LINEAR * n + QUADRATIC * n * n``, the attention
within it included. Documents are packed in groups of about ``GROUP_TOKENS``
tokens, as a task reads them, so that nothing is shuffled and a task holds one
group. A group has as many sequences as its tokens need. Documents longer than
a sequence first fill sequences of their own; then the documents, and the rests
of the long ones, go in descending order of cost to the sequence of lowest cost
that has room for the whole. What fits nowhere whole is cut to fill the room
left, so that the padding of a group is less than one sequence.

Defined results: a null text counts as empty, and an empty document is its end
token alone; repeated rows are packed as separate documents; documents of one
cost go in the order that they are read in, and of sequences of one cost the
first is taken; other columns are ignored; an empty table gives an empty result.
A text of any length is tokenized at once: about 100 bytes for each of its words.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import table, trimming

CAPACITY, END = 4096, 2
GROUP_TOKENS = 4_000_000
#: Cost of a token, and of a pair of tokens that attend to each other.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: Words whose ids a Python worker remembers.
CACHED_WORDS = 2_500_000


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


#: Texts that show whether a tokenizer works word by word.
PROBES = ("Some Words, in  lines.\nAND tabs\t too! ", " don't 12ab x*** (y) \"z\" a.b é, É; 1,5 ??", "\u00a0a\u2003b \x1cfoo\x1dbar İx Σας ﬁ ٣, #tag|%")


class WordTokenizer:
    """Ids of whole texts. Where a tokenizer drops white space, never joins what
    it separates and lower-cases ASCII, ids of words are remembered; which is
    tried on ``PROBES``. Any other tokenizer gets whole texts.

    Punctuation that ends a word is looked up apart, as the tokenizer cuts
    there too. Words of letters alone are encoded many at a time and told apart
    by the ids that end a word. Texts with a special token's string go to the
    tokenizer as a whole."""

    def __init__(self, path: str, cached_words: int = CACHED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.dtype = "<u2" if len(self.ends) <= 1 << 16 else "<u4"
        self.end = np.array([END], self.dtype).tobytes()
        self.known: dict[bytes, bytes] = {}
        self.cached_words = cached_words
        probes = [*PROBES, *(w for t in PROBES for w in t.split())]
        self.by_words = bool(self.ends.any()) and all(np.array_equal(a, np.append(self._ids(t), END)) for a, t in zip(self._by_words(probes), probes, strict=True))
        self.known.clear()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _one(self, text: str) -> bytes:
        return np.array(self._ids(text), self.dtype).tobytes()

    def _learn(self, fresh: list[bytes]) -> None:
        known = self.known
        texts = [w.decode() for w in fresh]
        plain = [i for i, t in enumerate(texts) if t.isalpha()]
        runs = [plain[at : at + 500] for at in range(0, len(plain), 500)]
        for run, found in zip(runs, self.tokenizer.encode_batch_fast([" ".join([texts[i] for i in run]) for run in runs], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, self.dtype)
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) == len(run):
                raw, size, at = ids.tobytes(), ids.itemsize, 0
                for i, e in zip(run, (stop * size).tolist(), strict=True):
                    known[fresh[i]] = raw[at:e]
                    at = e
        for w, t in zip(fresh, texts, strict=True):
            if w not in known:
                known[w] = self._one(t)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.by_words:
            return self._by_words(texts)
        return [np.array([*e.ids, END], "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _by_words(self, texts: list[str]) -> list[np.ndarray]:
        # lower-casing ASCII first is safe: the tokenizer does so itself
        split = [None if "<|" in t else t.encode().lower().split() for t in texts]
        known = self.known
        if len(known) > self.cached_words:
            known.clear()
        fresh = {w for s in split if s for w in s if w not in known}
        ends = {}
        for w in fresh:
            stem = w.rstrip(b".,!?:;*#$%&|")
            if stem and stem != w and (stem[-1:].isalnum() or stem[-1] > 127 and stem.decode()[-1].isalpha()):
                ends[w] = stem
        todo = {w for w in fresh if w not in ends}
        todo.update(x for w, stem in ends.items() for x in (stem, w[len(stem) :]) if x not in known)
        self._learn(list(todo))
        for w, stem in ends.items():
            known[w] = known[stem] + known[w[len(stem) :]]
        get = known.__getitem__
        raw = [(self._one(t) if s is None else b"".join(map(get, s))) + self.end for t, s in zip(texts, split, strict=True)]
        return [np.frombuffer(r, self.dtype).astype("<u4") for r in raw]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str, cached_words: int = CACHED_WORDS) -> WordTokenizer:
    """The worker's own tokenizer, with its memory, for all its tasks."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    _TOKENIZERS[path].cached_words = cached_words
    return _TOKENIZERS[path]


def packed(sizes: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece."""
    out, used, rest = [], 0, []
    for d, n in enumerate(sizes):
        for start in range(0, n - n % capacity, capacity):
            out.append((d, start, capacity, used, 0))
            used += 1
        if n % capacity:
            rest.append((n % capacity, d, n - n % capacity))
    first = used
    more = -(-sum(n for n, _, _ in rest) // capacity)
    room, spent = np.full(more, capacity), np.zeros(more)

    def put(n: int, d: int, start: int, s: int) -> None:
        out.append((d, start, n, first + s, capacity - int(room[s])))
        room[s] -= n
        spent[s] += cost(n)

    left = []
    for n, d, start in sorted(rest, key=lambda x: (-x[0], x[1])):
        open_ = np.where(room >= n, spent, np.inf)
        s = int(open_.argmin())
        if open_[s] < np.inf:
            put(n, d, start, s)
        else:
            left.append((n, d, start))
    # fill the fullest first: the room left is less than a sequence in all
    short = sorted(np.flatnonzero(room), key=lambda s: -room[s])
    for n, d, start in left:
        while n:
            s = short[-1]
            k = min(n, int(room[s]))
            put(k, d, start, s)
            n, start = n - k, start + k
            if not room[s]:
                short.pop()
    return out


SCHEMA = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double, ids array<int>"


def pack_documents(docs: DataFrame, path: str, with_ids: bool = True, group_tokens: int = GROUP_TOKENS, cached_words: int = CACHED_WORDS) -> DataFrame:
    """A row for each piece; ``ids`` are its tokens if ``with_ids``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def group(ids: list, tokens: list, serial: int) -> Iterator[pa.RecordBatch]:
        pieces = packed([len(t) for t in tokens])
        step = 256 if with_ids else 4096
        for at in range(0, len(pieces), step):
            part = pieces[at : at + step]
            cut = [tokens[d][s : s + n] for d, s, n, _, _ in part]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[p[0]] for p in part]),
                    pa.array([p[1] for p in part], pa.int64()),
                    pa.array([p[2] for p in part], pa.int64()),
                    pa.array([zlib.crc32(x.tobytes()) for x in cut], pa.int64()),
                    pa.array([len(tokens[p[0]]) for p in part], pa.int64()),
                    pa.array([serial + p[3] for p in part], pa.int64()),
                    pa.array([p[4] for p in part], pa.int64()),
                    pa.array([cost(p[2]) for p in part], pa.float64()),
                    pa.array([x.astype(np.int32) for x in cut] if with_ids else [None] * len(part), pa.list_(pa.int32())),
                ],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost", "ids"],
            )

    @trimming
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path, cached_words).encode
        serial = TaskContext.get().partitionId() << 33
        ids, tokens, total = [], [], 0
        for b in batches:
            names, texts = b.column(0), b.column(1)
            for at in range(0, b.num_rows, 200):
                for i, t in enumerate(encode([x or "" for x in texts[at : at + 200].to_pylist()])):
                    ids.append(names[at + i])
                    tokens.append(t)
                    total += len(t)
                if total >= group_tokens:
                    yield from group(ids, tokens, serial)
                    serial += -(-total // CAPACITY) + len(tokens)
                    ids, tokens, total = [], [], 0
        if tokens:
            yield from group(ids, tokens, serial)

    out = docs.select("doc_id", "text").mapInArrow(pack, SCHEMA.format(kind))
    return out if with_ids else out.drop("ids")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)

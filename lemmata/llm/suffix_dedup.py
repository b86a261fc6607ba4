"""Removal of long repeated passages by a distributed merge sort of suffixes.

Every byte covered by a ``LENGTH``-byte string that also starts elsewhere goes.
Not all suffixes are sorted: each ``LENGTH``-byte window is owned by its
*anchor*, the place of its ``ANCHOR``-byte string of least hash, which depends on
the window's content only. Equal windows thus have equal anchors at the same
offset, and only suffixes at anchors whose hash occurs twice or more need
sorting, each with the windows that it owns on its left.

A task sorts its suffixes, collapses equal ones to one record, front-codes the
run and cuts it into ranges of anchor hashes. Ranges are exchanged, and each is
merged by a loser tree that carries common prefixes. Prefixes shared with the
neighbours in the merged order bound which windows of a record can occur again;
those are told apart by a 64-bit hash of their content. Records that come back
give byte ranges, which are joined with the places that the tasks kept.

An anchor that occurs more than ``HOT`` times skips the merge: its records'
windows are counted by the anchor's hash and their own, 128 bits together, in an
aggregation, which sums within tasks first, so that no range grows with one
passage. Dividing such an anchor's records among ranges by their content would
not do: equal windows reach left and right of the anchor by all amounts, so that
their records may differ in any one part.

Defined results: a null text counts as empty and has nothing to remove; repeated
rows repeat each other's bytes; other columns are ignored; an empty table gives
an empty result. Removed bytes may split a character of several bytes; ``kept``
is therefore binary.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, released, table, trimming, written
from .losertree import decoded, front_coded, merged
from .textbytes import chunks, powers, prefix_hashes, span_hashes

LENGTH, ANCHOR = 200, 32
HOT = 5000
#: Anchors in a range, and records whose windows are told apart at once.
RANGE, BATCH = 20_000, 4_000
#: Bytes of a long text whose anchors are found at once.
PIECE = 1 << 21
#: Text bytes that a task sorts as one run.
RUN_BYTES = 8 << 20


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR):
    """(row, hash, place, first window, last window) of each anchor; places
    count from the row's start."""
    width, n = length - anchor + 1, len(data) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none, none
    sums = prefix_hashes(data)
    k = len(data) - anchor + 1
    h = (sums[anchor:] - sums[:k]) * powers(len(sums), True)[:k]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    # the place in the low bits breaks ties to the left; 2**31 bytes at once at most
    low = max(8, int(len(data)).bit_length())
    key = (h >> np.uint64(low) << np.uint64(low)) | np.arange(k, dtype=np.uint64)
    # sliding minimum: running minima from both sides of blocks of ``width``
    pad = -k % width
    blocks = np.concatenate([key, np.full(pad, ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:n], ahead[width - 1 : width - 1 + n])
    place = (least & ((np.uint64(1) << np.uint64(low)) - np.uint64(1))).astype(np.int64)
    # windows that lie within a row
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size)[:n]
    start = np.arange(n)
    inside = np.flatnonzero(start + length <= offsets[1:][row])
    if not len(inside):
        return none, none, none, none, none
    place, row = place[inside], row[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(inside)) - 1
    row, place = row[first], place[first]
    base = offsets[:-1][row]
    # an anchor's hash is the least of many; mixed again it is even over the ranges
    return row, mix64(h[place]).view(np.int64), place - base, inside[first] - base, inside[last] - base


@trimming
def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at, data, offsets in chunks(b.column(1)):
            # a long text in pieces that overlap by a window; an anchor may then
            # come twice, with other windows each time
            for base in range(0, max(1, len(data)), PIECE) if len(offsets) == 2 else (0,):
                part = data[base : base + PIECE + LENGTH - 1] if len(offsets) == 2 else data
                row, h, place, first, last = anchors(part, np.array([0, len(part)]) if len(offsets) == 2 else offsets)
                packed = (place + base) << 16 | (place - first) << 8 | (place - last)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row + at)), pa.array(h), pa.array(packed)], names=["k", "h", "p"])


@trimming
def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=1)
    for b in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
        z = [press.compress((t or "").encode()) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(z, pa.binary()), *b.columns[2:]], names=["k", "z", *b.schema.names[2:]])


def squeezed(docs: DataFrame, *more: str) -> DataFrame:
    """Texts by their key, compressed for their way through a shuffle."""
    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in more)
    return docs.select("k", "text", *more).mapInArrow(_squeeze, f"k long, z binary{kinds}")


def record_key(h: int, right: bytes, left: bytes) -> bytes:
    """Hash, suffix at the anchor, then what lies left of it, read backwards."""
    return struct.pack(">Q", h & 0xFFFFFFFFFFFFFFFF) + right + left[::-1]


def _runs(ranges: int):
    """Sorted runs of a task, cut into ranges; the places of their records; and
    the window hashes of records of hot anchors."""
    names = ["target", "run", "hashes", "k", "at", "rec"]

    @trimming
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 33
        press, open_ = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        found: dict[tuple[bytes, int, bool], list] = {}
        places: list[tuple[int, list, list]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal serial
            order = sorted(found)
            out: dict[int, list] = {}
            hot = []
            for i, f in enumerate(order):
                f_at = found[f]
                f_at[0] = serial + i
                if f[2]:
                    hot.append((f, f_at))
                else:
                    out.setdefault(((struct.unpack_from(">Q", f[0])[0] >> 32) * ranges) >> 32, []).append((f[0], f[1], f_at[0], f_at[1]))
            serial += len(order)
            for target, records in out.items():
                head = np.array([(left, rec, min(2, times)) for _, left, rec, times in records], np.int64)
                body = front_coded(r[0] for r in records)
                blob = struct.pack("<I", len(records)) + head.tobytes() + body
                yield batch([(target, press.compress(blob), None, None, None, None)])
            for at in range(0, len(hot), 2000):
                part = hot[at : at + 2000]
                keys = [window_hashes([f[0]], [f[1]]) for f, _ in part]
                yield batch([(min(2, v[1]), None, w[0].tolist(), None, None, [v[0], w[1][0], struct.unpack_from(">q", f[0])[0]]) for (f, v), w in zip(part, keys, strict=True)])
            for at in range(0, len(places), 2000):
                yield batch([(None, None, None, k, a, [found[f][0] for f in fs]) for k, a, fs in places[at : at + 2000]])

        def batch(rows: list) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            for k, z, spots in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                text = open_.decompress(z.as_py())
                size += len(text)
                at, which = [], []
                for s in spots:
                    place, left, back = s["p"] >> 16, s["p"] >> 8 & 255, s["p"] & 255
                    key = record_key(s["h"], text[place : place - back + LENGTH], text[place - left : place])
                    f = (key, left, s["hot"])
                    found.setdefault(f, [0, 0])[1] += 1
                    at.append(place)
                    which.append(f)
                places.append((k, at, which))
                if size > RUN_BYTES:
                    yield from flush()
                    found, places, size = {}, [], 0
        yield from flush()

    return run


def window_hashes(keys: list[bytes], lefts: list[int], least: np.ndarray | None = None):
    """Hashes of the records' windows, one record after the other, each from
    its leftmost on; and the offset of each record's leftmost window. Windows
    less than ``least`` left of the anchor are left out."""
    texts = []
    for key, left in zip(keys, lefts, strict=True):
        right = key[8 : len(key) - left]
        texts.append(key[len(key) - left :][::-1] + right)
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts])
    left = np.array(lefts)
    count = size - LENGTH + 1
    if least is not None:
        count = np.clip(np.minimum(count, left - least + 1), 0, None)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    total = int(count.sum())
    start = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(total)
    return span_hashes(prefix_hashes(data), start, start + LENGTH).view(np.int64), -left, count


def covered(rows: list[tuple[bytes, int, int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, from, to), relative to the anchor, of windows that occur twice.
    ``rows`` has (key, left, record, times, longest prefix shared with either
    neighbour); all rows of an anchor's hash must be there."""
    keys, lefts, recs, times, share = zip(*rows, strict=True)
    # a window reaching right beyond the shared prefix occurs once, unless its record does twice
    least = np.where(np.array(times) > 1, 0, np.maximum(0, LENGTH + 8 - np.array(share)))
    h, base, count = window_hashes(list(keys), list(lefts), least)
    owner = np.repeat(np.arange(len(rows)), count)
    _, inverse = np.unique(h, return_inverse=True)
    twice = np.bincount(inverse, np.array(times)[owner])[inverse] > 1 if len(h) else np.zeros(0, bool)
    offset = base[owner] + np.arange(len(h)) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    owner, offset = owner[twice], offset[twice]
    if not len(owner):
        return (np.zeros(0, np.int64),) * 3
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(owner)) - 1
    return np.array(recs)[owner[first]], offset[first], offset[last] + LENGTH


@trimming
def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_ = zstandard.ZstdDecompressor()

    def result(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in covered(rows)], names=["rec", "s", "e"])

    for b in batches:
        for blobs in b.column(0):
            runs, heads = [], []
            for z in blobs:
                blob = open_.decompress(z.as_py())
                n = struct.unpack_from("<I", blob)[0]
                heads.append(iter(np.frombuffer(blob, np.int64, 3 * n, 4).reshape(n, 3).tolist()))
                runs.append(decoded(blob[4 + 24 * n :]))
            rows: list = []
            alone = True  # the last row is the only one of its hash so far
            for key, share, i in merged(runs):
                left, rec, times = next(heads[i])
                if share < 8:
                    if rows and alone and rows[-1][3] < 2:
                        rows.pop()
                    alone = True
                    if len(rows) >= BATCH:
                        yield result(rows)
                        rows = []
                else:
                    alone = False
                    if share > rows[-1][4]:
                        rows[-1] = (*rows[-1][:4], share)
                rows.append((key, left, rec, times, share))
            if rows:
                yield result(rows)


def _apply(with_kept: bool):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

    @trimming
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for b in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            out = []
            for z, ranges in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                text = open_.decompress(z.as_py())
                spans: list[list[int]] = []
                for r in sorted((x["s"], x["e"]) for x in ranges or ()):
                    if spans and r[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], r[1])
                    else:
                        spans.append(list(r))
                kept, at = [], 0
                for s, e in spans:
                    kept.append(text[at:s])
                    at = e
                left = b"".join([*kept, text[at:]])
                out.append((len(text), len(text) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left if with_kept else None))
            yield pa.RecordBatch.from_arrays([b.column(2), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], names=names)

    return run


def remove_repeats(docs: DataFrame, hot: int = HOT, with_kept: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row;
    ``kept`` is null unless ``with_kept``."""
    spark = docs.sparkSession
    # rows that agree in doc_id and text agree in their result, so this key may stand for both
    source = docs.select(F.xxhash64("doc_id", "text").alias("k"), "doc_id", "text")
    found = source.where(F.octet_length("text") >= LENGTH).select("k", "text").mapInArrow(_find, "k long, h long, p long")
    # a table of its own, so that the join can split the rows of a frequent hash
    twice = written(found.groupBy("h").count().where("count > 1").select("h", (F.col("count") > hot).alias("hot")), "twice")
    spots = written(found.join(twice, "h"), "anchors")
    released(spark)
    by_text = spots.dropDuplicates(["k", "p"]).groupBy("k").agg(F.collect_list(F.struct("h", "p", "hot")).alias("spots"))
    held = squeezed(source).join(by_text, "k").select("k", "z", "spots")
    ranges = max(1, spots.count() // RANGE)
    runs = written(held.mapInArrow(_runs(ranges), "target long, run binary, hashes array<long>, k long, at array<long>, rec array<long>"), "runs", 200)
    released(spark)
    merge = runs.where("run is not null").groupBy("target").agg(F.collect_list("run").alias("runs"))
    back = merge.select("runs").mapInArrow(_merge, "rec long, s long, e long")
    windows = runs.where("hashes is not null").select(F.col("target").alias("times"), F.get("rec", F.lit(0)).alias("rec"), F.get("rec", F.lit(1)).alias("base"), F.get("rec", F.lit(2)).alias("anchor"), F.posexplode("hashes").alias("i", "hash"))
    again = windows.groupBy("anchor", "hash").agg(F.sum("times").alias("n")).where("n > 1").select("anchor", "hash")
    s = F.col("base") + F.col("i")
    back = written(back.union(windows.join(again, ["anchor", "hash"]).select("rec", s, s + LENGTH)), "covered", 1)
    places = runs.where("k is not null").select("k", F.explode(F.arrays_zip("at", "rec")).alias("x")).select("k", "x.at", "x.rec")
    spans = places.join(back, "rec").groupBy("k").agg(F.collect_set(F.struct((F.col("at") + F.col("s")).alias("s"), (F.col("at") + F.col("e")).alias("e"))).alias("ranges"))
    spans = written(spans, "spans")
    released(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = squeezed(source, "doc_id").join(spans, "k", "left").select("z", "ranges", "doc_id")
    return out.mapInArrow(_apply(with_kept), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_kept=False).drop("kept")


#: The same by counting all windows.
SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, p, md5_number(substring(h, 2 * p + 1, 400)) AS m FROM (SELECT r, h, unnest(range(0, greatest(0, len(h) // 2 - 199))) AS p FROM d)),
t AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
s AS (SELECT r, p, coalesce(p > 200 + lag(p) OVER (PARTITION BY r ORDER BY p), true) AS fresh FROM w SEMI JOIN t USING (m)),
g AS (SELECT r, p, sum(fresh::INT) OVER (PARTITION BY r ORDER BY p) AS span FROM s),
v AS (SELECT r, span, min(p) AS a, max(p) + 200 AS b FROM g GROUP BY r, span),
k AS (SELECT v.r, sum(b - a) AS gone, count(*) AS spans, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM v GROUP BY v.r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN spans IS NULL THEN h ELSE array_to_string(list_transform(range(0, spans + 1), lambda i:
         substring(h, CASE WHEN i = 0 THEN 1 ELSE 2 * ends[i] + 1 END, CASE WHEN i = spans THEN len(h) ELSE 2 * starts[i + 1] END - CASE WHEN i = 0 THEN 0 ELSE 2 * ends[i] END)), '') END)) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""

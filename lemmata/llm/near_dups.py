"""Near duplicates by MinHash signatures in an LSH forest.

A document's set is its distinct shingles of five words. Documents of equal
sets are one class, and classes are linked if the Jaccard similarity of their
sets reaches ``percent``; links are confirmed on the full sets.

Candidates come from trees, each an order of the classes by its own
part of the signature. Classes with ``DEPTH`` values in common form a region.
In a region of ``REGION`` classes at most all are compared. A larger one is
sorted by its tree's whole order, and each class is compared with the ones
before it, those with the longest common prefix: the depth follows how crowded
the region is. What crowded regions leave in different components is then
compared in full, block by block: every class outside a region's largest
component with every class of the region. So no candidate is lost to the limit
on neighbours; what remains is the forest's own miss, ``MISS`` at most for a
pair at the threshold: the number of trees follows from ``percent``, 20 at 85
and 29 at 80.

Shingles are compared by 64-bit hashes. A class is known by the size of its set
and 128 bits of the set's content.

Defined results: a null or empty text, or one without words, has an empty set
and is linked with nothing; with fewer than five words the whole sequence is the
one shingle; repeated rows belong to one component; rows of one ``doc_id`` with
unlike texts are told apart, and each gets the smallest id of its own text's
component; a row without a ``doc_id`` is linked with nothing; other columns are
ignored; an empty table gives an empty result. ``doc_id`` is an integer. A text
of any length is one row, and its set is held whole, 8 bytes a shingle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, table, trimming, written
from .components import Forest, components
from .textbytes import LOWER_VALUES, chunks, prefix_hashes, span_hashes, words

WORDS, PERCENT = 5, 85
DEPTH, DEEPEST = 5, 8
#: Probability that no tree has a pair at the threshold in one region.
MISS = 1e-5
REGION, NEIGHBOURS = 32, 3
#: Estimated similarity below which a neighbour in a crowded region is no candidate yet.
LIKELY = 0.7
#: Classes in a block of those outside the largest component, and of all; and shingles in either, about.
ASKING, ASKED = 128, 512
BLOCK_SHINGLES = 1 << 20
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def forest_size(percent: int) -> int:
    """Trees that keep the miss of a pair at the threshold within ``MISS``."""
    return math.ceil(math.log(MISS) / math.log1p(-((min(percent, 99) / 100) ** DEPTH)))


@lru_cache(4)
def _probes(size: int) -> np.ndarray:
    """For each value of a signature, where an empty one is taken from, in turn."""
    rounds = 2 * size // 5
    return (mix64(np.arange(1, rounds * size + 1, dtype=np.uint64)) % np.uint64(size)).astype(int).reshape(rounds, size)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, sorted, one row after the other, and how
    many each has."""
    rows = len(offsets) - 1
    start, end, row = words(data, offsets)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    h = span_hashes(prefix_hashes(data, LOWER_VALUES), start, end)
    count = np.bincount(row, minlength=rows)
    n = len(h)
    total = h * _PLACES[0]
    short = np.zeros(n, bool)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    for k in range(1, min(WORDS, n)):
        total[: n - k] += h[k:] * _PLACES[k]
    whole = np.arange(n) + WORDS <= (first + count)[row]
    brief = np.flatnonzero((count > 0) & (count < WORDS))
    for r in brief:
        w = h[first[r] : first[r] + count[r]]
        total[first[r]] = (w * _PLACES[: len(w)]).sum() + np.uint64(len(w))
    short[first[brief]] = True
    use = whole | short
    values, row = mix64(total[use]), row[use]
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return values[fresh], np.bincount(row[fresh], minlength=rows)


def signatures(values: np.ndarray, count: np.ndarray, trees: int) -> np.ndarray:
    """16-bit signatures by one permutation: the least value of each bin, an
    empty bin taking that of another by a fixed order of probes."""
    size = trees * DEEPEST
    row = np.repeat(np.arange(len(count)), count)
    least = np.full(len(count) * size, _EMPTY)
    np.minimum.at(least, row * size + (values % np.uint64(size)).astype(np.int64), values // np.uint64(size))
    least = least.reshape(len(count), size)
    empty = least == _EMPTY
    out, todo = least.copy(), empty & (count > 0)[:, None]
    for probe in _probes(size):
        if not todo.any():
            break
        r, c = np.nonzero(todo)
        p = probe[c]
        found = ~empty[r, p]
        out[r[found], c[found]] = least[r[found], p[found]]
        todo[r[found], c[found]] = False
    return (mix64(out) >> np.uint64(48)).astype(np.uint16)


def _fingerprints(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Two 64-bit sums over each set, as signed integers."""
    ends = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros((len(count), 2), np.uint64)
    for i, x in enumerate((values, values ^ np.uint64(0x5851F42D4C957F2D))):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(x), dtype=np.uint64)])
        out[:, i] = sums[ends[1:]] - sums[ends[:-1]]
    return out.view(np.int64)


def _region_keys(sig: np.ndarray) -> np.ndarray:
    trees = sig.shape[1] // DEEPEST
    part = sig.reshape(len(sig), trees, DEEPEST)[:, :, :DEPTH].astype(np.uint64)
    return mix64((part * _PLACES[:DEPTH]).sum(2, dtype=np.uint64) + mix64(np.arange(1, trees + 1, dtype=np.uint64))).view(np.int64)


def _binaries(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())


def _sketch(trees: int):
    @trimming
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, data, offsets in chunks(b.column(1)):
                values, count = shingle_sets(data, offsets)
                sig, prints = signatures(values, count, trees), _fingerprints(values, count)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, trees * len(count) + 1, trees), pa.int32()), pa.array(_region_keys(sig).ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(count)), b.column(2).slice(at, len(count)), pa.array(count), pa.array(prints[:, 0]), pa.array(prints[:, 1]), keys, _binaries(sig)], names=["doc_id", "t", "n", "f1", "f2", "keys", "sig"])

    return run


@trimming
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Full sets, of rows whose fingerprint is the expected one."""
    for b in batches:
        for at, data, offsets in chunks(b.column(1)):
            values, count = shingle_sets(data, offsets)
            k = len(count)
            prints = _fingerprints(values, count)
            good = (prints[:, 0] == b.column(2).slice(at, k).to_numpy()) & (prints[:, 1] == b.column(3).slice(at, k).to_numpy())
            parts = np.split(values, np.cumsum(count)[:-1])
            yield pa.RecordBatch.from_arrays([b.column(0).slice(at, k), pa.array([p.tobytes() for p in parts], pa.binary())], names=["id", "set"]).filter(pa.array(good))


def linked(common, n, m, percent: int = PERCENT):
    return 100 * common >= percent * (n + m - common)


def _verify(percent: int):
    @trimming
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()  # a task sends on a spanning forest of its links
        for b in batches:
            out = []
            for i, j, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                if forest.find(i) != forest.find(j):
                    x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                    if linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent):
                        forest.join(i, j)
                        out.append((i, j))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _neighbours(percent: int):
    """Pairs of rows that lie close in the order of a crowded region."""

    @trimming
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: list[tuple] = []
        for b in batches:
            out = []
            for key, i, n, sig in zip(*(b.column(c).to_pylist() for c in range(3)), b.column(3), strict=True):
                sig = np.frombuffer(sig.as_py(), np.uint16)
                for k, j, m, s in recent:
                    if k == key and i != j and 100 * min(n, m) >= percent * max(n, m) and (sig == s).mean() >= LIKELY:
                        out.append((min(i, j), max(i, j)))
                recent = [*recent[1 - NEIGHBOURS :], (key, i, n, sig)]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def common_counts(x: list[np.ndarray], y: list[np.ndarray], slab: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets of ``x`` with all of ``y``."""
    out = np.zeros((len(x), len(y)), np.float32)
    vx, vy = np.concatenate(x), np.concatenate(y)
    shared = np.intersect1d(vx, vy)
    rx, ry = np.repeat(np.arange(len(x)), [len(s) for s in x]), np.repeat(np.arange(len(y)), [len(s) for s in y])
    px, py = np.searchsorted(shared, vx), np.searchsorted(shared, vy)
    ix = np.flatnonzero((px < len(shared)) & (shared[np.minimum(px, len(shared) - 1)] == vx)) if len(shared) else np.zeros(0, int)
    iy = np.flatnonzero((py < len(shared)) & (shared[np.minimum(py, len(shared) - 1)] == vy)) if len(shared) else np.zeros(0, int)
    ix, iy = ix[np.argsort(px[ix], kind="stable")], iy[np.argsort(py[iy], kind="stable")]
    for at in range(0, len(shared), slab):
        width = min(slab, len(shared) - at)
        mx, my = np.zeros((len(x), width), np.float32), np.zeros((len(y), width), np.float32)
        for m, i, p, r in ((mx, ix, px, rx), (my, iy, py, ry)):
            i = i[np.searchsorted(p[i], at) : np.searchsorted(p[i], at + width)]
            m[r[i], p[i] - at] = 1
        out += mx @ my.T
    return out


def _blocks(percent: int):
    """Links between components within a block of a crowded region."""

    @trimming
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for b in batches:
            out = []
            for r in range(b.num_rows):
                asking, asked = b.column(0)[r].as_py(), b.column(1)[r].as_py()
                ci, cj = (np.array([e["component"] for e in x]) for x in (asking, asked))
                x, y = ([np.frombuffer(e["set"], np.uint64) for e in s] for s in (asking, asked))
                n, m = np.array([len(s) for s in x]), np.array([len(s) for s in y])
                hit = linked(common_counts(x, y), n[:, None], m[None, :], percent) & (ci[:, None] != cj[None, :])
                pairs = np.unique(np.column_stack([ci[np.nonzero(hit)[0]], cj[np.nonzero(hit)[1]]]), axis=0)
                out += [(a, c) for a, c in pairs.tolist() if forest.join(a, c)]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _classes(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, f1, f2) of every row; and (n, f1, f2, component, first) of
    every class, ``first`` being the smallest ``doc_id`` in it, with the hash of
    its text. Components are told apart by ``component``, not by their ids."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t"))
    base = written(source.mapInArrow(_sketch(forest_size(percent)), "doc_id long, t long, n long, f1 long, f2 long, keys array<long>, sig binary"), "sketches")
    classes = base.where("n > 0 and doc_id is not null").groupBy("n", "f1", "f2").agg(F.min(F.struct("doc_id", "t")).alias("first"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    # a set of n is at best linked with one of n + 1 that holds it
    large = classes.where(100 * F.col("n") >= percent * (F.col("n") + 1)).select("n", "f1", "f2", "id", F.col("first.doc_id").alias("doc_id"), F.col("first.t").alias("t"))
    heads = base.join(large, ["n", "f1", "f2", "doc_id", "t"]).dropDuplicates(["id"])
    heads = written(heads.select("id", "doc_id", "t", "n", "f1", "f2", "keys", "sig"), "heads")

    rows = heads.select("id", "n", F.posexplode("keys").alias("tree", "key"))
    crowd = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    rows = written(rows.join(crowd, "key"), "regions")
    few = rows.where(F.col("size") <= REGION).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("m"))
    few = few.select(F.posexplode("m").alias("at", "x"), "m").select("x", F.explode(F.slice("m", F.col("at") + 2, F.lit(REGION))).alias("y"))
    few = few.where(100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    crowded = rows.where(F.col("size") > REGION).join(heads.select("id", "sig"), "id")
    # signatures turned, so that each begins with its tree's own values
    turned = F.expr(f"concat(substring(sig, {2 * DEEPEST} * tree + 1), substring(sig, 1, {2 * DEEPEST} * tree))")
    crowded = written(crowded.select("key", "id", "n", turned.alias("sig")), "crowded")
    order = crowded.repartitionByRange(spark.sparkContext.defaultParallelism * 4, "key", "sig").sortWithinPartitions("key", "sig", "id")
    close = order.mapInArrow(_neighbours(percent), "a long, b long")
    pairs = written(few.union(close).distinct(), "pairs")

    needed = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(crowded.select("id")).distinct()
    needed = needed.join(heads.select("id", "doc_id", "t", "f1", "f2"), "id")
    full = source.join(needed, ["doc_id", "t"]).select("id", "text", "f1", "f2").mapInArrow(_sets, "id long, set binary")
    sets = written(full.dropDuplicates(["id"]), "sets")
    left, right = sets.select(F.col("id").alias("a"), F.col("set").alias("x")), sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
    links = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_verify(percent), "a long, b long")
    links = written(links, "links", 200)
    found = components(links)

    # what crowded regions leave apart
    member = crowded.select("key", "id", "n").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    member = written(member, "members")
    parts = member.groupBy("key", "component").agg(F.count("*").alias("k"), F.sum("n").alias("shingles")).groupBy("key").agg(F.count("*").alias("parts"), F.sum("k").alias("size"), F.sum("shingles").alias("shingles"), F.max_by("component", F.struct("k", "component")).alias("largest"))
    member = member.join(parts.where("parts > 1"), "key").join(sets, "id")
    entry = F.struct("component", "set")
    few_asking, few_asked = (F.ceil(F.greatest((F.col("size") + 1) / k, F.col("shingles") / BLOCK_SHINGLES)).cast("int") for k in (ASKING, ASKED))
    member = member.withColumn("p", F.pmod(F.xxhash64("id"), few_asking)).withColumn("q", F.pmod(F.xxhash64("id"), few_asked)).withColumn("q_all", few_asked)
    asking = member.where("component <> largest").groupBy("key", "p").agg(F.collect_list(entry).alias("asking"), F.first("q_all").alias("q_all"))
    asking = asking.select("key", "asking", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q_all") - F.lit(1).cast("long"))).alias("q"))
    asked = member.groupBy("key", "q").agg(F.collect_list(entry).alias("asked"))
    more = written(asking.join(asked, ["key", "q"]).select("asking", "asked").mapInArrow(_blocks(percent), "a long, b long"), "more-links", 4)
    if not more.isEmpty():
        merged = components(more).select(F.col("id").alias("component"), F.col("component").alias("to"))
        lone = merged.select(F.col("component").alias("id"), "to").join(found, "id", "left_anti").select("id", F.col("to").alias("component"))
        found = written(found.join(merged, "component", "left").select("id", F.coalesce("to", "component").alias("component")).union(lone), "components")

    named = classes.join(found, "id", "left").select("n", "f1", "f2", F.coalesce("component", "id").alias("component"), "first")
    return base.select("doc_id", "n", "f1", "f2"), named


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    base, named = _classes(docs, percent)
    least = named.groupBy("component").agg(F.min("first.doc_id").alias("component_id"))
    named = named.select("n", "f1", "f2", "component").join(least, "component").drop("component")
    # a row without an id is in no class
    keyed = base.withColumn("_n", F.when(F.col("doc_id").isNotNull(), F.col("n")))
    out = keyed.join(named.withColumnRenamed("n", "_n"), ["_n", "f1", "f2"], "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def one_of_each(docs: DataFrame, percent: int) -> DataFrame:
    """``docs`` with one row of each component, the one of smallest ``doc_id``
    and then of smallest hash of its text. Rows that are linked with nothing,
    those without words or ``doc_id`` included, all stay."""
    _, named = _classes(docs, percent)
    chosen = named.groupBy("component").agg(F.min("first").alias("first")).select("first.doc_id", "first.t")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), row.alias("row"))
    kept = keyed.join(chosen, ["doc_id", "t"], "left_semi").dropDuplicates(["doc_id", "t"]).select("row.*")
    return kept.unionByName(docs.where(F.col("doc_id").isNull() | F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def op1_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), PERCENT)


#: The same by comparing all texts that share a shingle.
SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
s AS (
  SELECT r, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM d),
x AS (SELECT r, unnest(g) AS h FROM s),
c AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM x a JOIN x b ON a.h = b.h AND a.r < b.r GROUP BY a.r, b.r),
l AS (SELECT a, b FROM c JOIN s p ON p.r = a JOIN s q ON q.r = b WHERE 100 * n >= {PERCENT} * (len(p.g) + len(q.g) - n)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach(r, other) AS (SELECT r, r FROM d UNION SELECT reach.r, e.b FROM reach JOIN e ON reach.other = e.a),
least AS (SELECT reach.r, min(o.doc_id) AS component_id FROM reach JOIN d o ON o.r = reach.other GROUP BY reach.r)
SELECT d.doc_id, len(s.g)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN s USING (r) JOIN least USING (r)
"""

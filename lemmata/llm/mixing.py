"""Mixing sources to target weights along a time-varying curriculum.

Sizes are words. Each source gets a target by weighted sharing with a cap of
``max_epochs`` times its size, the excess being shared anew. A source's
documents, in an order fixed by a hash of ``doc_id``, form a stream that is
read again from its start after its end; the mix takes the target's worth of
words from it, so that the last document taken may be cut.

When a word of a source is seen in training follows from the source's weight
schedule: a piecewise linear density over training time 0..1. Its integral is
the source's cumulative demand, and inverting that gives the time at which the
k-th word is due. Documents are range-sorted by that time.

Hot sources: running sums are taken within slices of about ``SLICE_ROWS``
documents of a source, and only the slices' sums are summed per source.
Documents of one id and size follow each other and are counted in ``SALTS``
portions first, so that an id, or a missing one, held by a third of all rows
stays divided.

Defined results: a null text has size 0 and takes nothing; a null source is a
source of its own, sorted last; repeated rows are separate documents, ordered
among themselves by size; a text of any length is only counted; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, table, written

#: Documents in a slice of a source, about, and slices of a source at most.
SLICE_ROWS, MAX_SLICES = 500, 65_536
SALTS = 256
#: Sources up to which their targets are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000
#: Weight schedules as (time, weight) knots, dealt to sources in turn: one that
#: fades out, one that comes in, and one with a hump.
CURRICULUM = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 0.8), (0.5, 1.4), (1.0, 0.4)))


def size(text: Column) -> Column:
    """Number of words of the whole text."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights=(3, 1, 2), share: float = 1.5, max_epochs: float = 2.0) -> dict:
    """Target of each source: ``share`` of all sizes by ``weights`` dealt in
    code-point order, null last, none above ``max_epochs`` times its size. The
    plain form of ``with_targets``."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: float(weights[i % len(weights)]) for i, (s, _) in enumerate(order)}
    left = share * sum(n for _, n in sizes)
    out, open_ = {}, dict(order)
    while open_:
        rate = left / sum(weight[s] for s in open_)
        full = [s for s, n in open_.items() if rate * weight[s] > max_epochs * n]
        if not full:
            return out | {s: round(rate * weight[s], 6) for s in open_}
        for s in full:
            out[s] = max_epochs * open_.pop(s)
            left -= out[s]
    return out


def due(word: Column, target: Column, knots: Column) -> Column:
    """Training time 0..1 at which a source's ``word``-th word is due.

    ``knots`` holds (t, w, a): time, density and the integral up to there of
    the schedule, scaled to an integral of 1. In the piece that the wanted
    integral falls into, w*x + (w2-w)/(t2-t)*x*x/2 is inverted."""
    want = F.when(target > 0, F.least(word / target, F.lit(1.0))).otherwise(F.lit(0.0))

    def piece(i):
        k, nxt = F.get(knots, i), F.get(knots, i + 1)
        slope = (nxt["w"] - k["w"]) / (nxt["t"] - k["t"])
        rest = want - k["a"]
        root = F.sqrt(F.greatest(k["w"] * k["w"] + 2 * slope * rest, F.lit(0.0)))
        x = F.when(k["w"] + root > 0, 2 * rest / (k["w"] + root)).otherwise(F.lit(0.0))
        return F.least(k["t"] + x, nxt["t"])

    at = F.aggregate(knots, F.lit(-1), lambda n, k: F.when(k["a"] <= want, n + 1).otherwise(n))
    return piece(F.greatest(F.lit(0), F.least(at, F.size(knots) - 2)))


def integrated(schedule) -> list[tuple[float, float, float]]:
    """(time, density, integral) with the whole integral scaled to 1."""
    area, out = 0.0, []
    for i, (t, w) in enumerate(schedule):
        if i:
            area += (t - schedule[i - 1][0]) * (w + schedule[i - 1][1]) / 2
        out.append((float(t), float(w), area))
    return [(t, w / area, a / area) for t, w, a in out]


def with_targets(sources: DataFrame, weights=(3, 1, 2), share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """``sources`` (source, n) with each one's place ``i`` and ``target``. The
    sources of least limit to weight are full first; the first that the rate of
    what is then left does not fill, and all after it, get that rate. One row
    for each source; the windows over all of them spill."""
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), F.pmod("i", F.lit(len(weights))).cast("int") + 1)
    dealt = sources.withColumn("i", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1).withColumn("w", weight)
    limit = F.col("n") * F.lit(float(max_epochs))
    order = Window.orderBy("ratio", "i")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.desc("ratio"), F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    rated = dealt.withColumn("limit", limit).withColumn("ratio", F.col("limit") / F.col("w"))
    rated = rated.withColumn("total", F.sum("n").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * F.lit(float(share)))
    rated = rated.withColumn("rate", (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("w").over(after))
    held = F.first(F.when(F.col("rate") <= F.col("ratio"), F.col("rate")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    target = F.when(held.isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), F.round(held * F.col("w"), 6)))
    return rated.withColumn("target", target).drop("limit", "ratio", "total", "rate", "w")


def with_shares(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, curriculum=CURRICULUM, carry: dict[str, Column] | None = None) -> DataFrame:
    """For every row its ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``start`` (words of
    its source before it), ``taken`` and, for each reading of the stream that
    takes words of it, an element (words, position) of ``readings``; and what
    ``carry`` adds to these, under its names."""
    carry = carry or {}
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    lean = docs.select("doc_id", "source", size(F.col("text")).alias("size"), key.alias("_key"), *(c.alias(k) for k, c in carry.items()), F.monotonically_increasing_id().alias("_row"))
    lean = written(lean, "sizes")
    sources = written(lean.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")), "sources")
    knots = [F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip("twa", k, strict=True))) for k in integrated(c))) for c in curriculum]
    plan = with_targets(sources, weights, share, max_epochs).select(
        F.col("source").alias("_source"), F.col("n").alias("source_size"), "target",
        F.least(F.lit(MAX_SLICES), F.greatest(F.lit(1), F.floor(F.col("rows") / SLICE_ROWS))).cast("long").alias("slices"),
        F.element_at(F.array(*knots), F.pmod("i", F.lit(len(knots))).cast("int") + 1).alias("knots"),
    )
    if sources.count() <= BROADCAST_SOURCES:  # rows of a few hundred bytes
        plan = F.broadcast(plan)
    lean = lean.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    lean = lean.withColumn("_slice", F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * F.col("slices") / F.lit(2**32))).withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)))
    portion = ("source", "_slice", "_key", "size", "_salt")
    portions = lean.groupBy(*portion).agg((F.count("*") * F.col("size")).alias("_n"))
    sums = portions.groupBy("source", "_slice").agg(F.sum("_n").alias("_n"))
    before = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("source", "_slice").orderBy("_key", "size", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    portions = portions.withColumn("_in", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    portions = _same(portions, sums, ("source", "_slice"))
    number = F.row_number().over(Window.partitionBy(*portion).orderBy("_row")) - 1
    placed = _same(lean.withColumn("_at", number), portions.drop("_n"), portion)
    whole = F.round("target").cast("long")
    placed = placed.withColumn("start", F.col("_base") + F.col("_in") + F.col("_at") * F.col("size"))

    def taken(epoch: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("size"), whole - F.col("start") - epoch * F.col("source_size")))

    epochs = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).cast("int") - 1))
    readings = F.transform(
        F.filter(F.transform(epochs, lambda e: F.struct(e.alias("e"), taken(e).alias("n"))), lambda x: x["n"] > 0),
        lambda x: F.struct(x["n"].alias("words"), due(F.col("start") + x["e"] * F.col("source_size"), F.col("target"), F.col("knots")).alias("position")),
    )
    return placed.withColumn("readings", readings).withColumn(
        "taken", F.aggregate("readings", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    ).select("doc_id", "source", "size", "source_size", "target", "start", "taken", "readings", *carry)


def _same(left: DataFrame, right: DataFrame, columns) -> DataFrame:
    """Inner join on equal columns, where null equals null in the first."""
    named = right.select(*(F.col(c).alias(f"_{c}") for c in columns), *(c for c in right.columns if c not in columns))
    on = F.col(columns[0]).eqNullSafe(F.col(f"_{columns[0]}"))
    for c in columns[1:]:
        on = on & (F.col(c) == F.col(f"_{c}"))
    return left.join(named, on).drop(*(f"_{c}" for c in columns))


def in_training_order(mixed: DataFrame) -> DataFrame:
    """A row for each reading of a document, range-sorted by its position."""
    out = mixed.select("*", F.posexplode("readings").alias("reading", "_r"))
    return out.select(*mixed.drop("readings").columns, "reading", F.col("_r.words").alias("words"), F.col("_r.position").alias("position")).orderBy("position", "doc_id", "reading")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = with_shares(table(spark, sf_dir, "documents"))
    first = F.get("readings", F.lit(0))["position"]
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "start", F.size("readings").alias("n_readings"), F.round(first, 6).alias("position")).orderBy("position", "doc_id")


SQL = """
WITH d AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS key,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w FROM s),
o AS (
  SELECT *, 2.0::DOUBLE * n / w AS ratio,
         (1.5::DOUBLE * (SELECT sum(n) FROM s) - coalesce(sum(2.0::DOUBLE * n) OVER (ORDER BY 2.0::DOUBLE * n / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY 2.0::DOUBLE * n / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
  FROM w),
r AS (SELECT rate FROM o WHERE rate <= ratio ORDER BY ratio, i LIMIT 1),
t AS (SELECT w.*, coalesce(least(2.0::DOUBLE * n, round((SELECT rate FROM r) * w, 6)), 2.0::DOUBLE * n) AS target FROM w),
p AS (
  SELECT d.doc_id, d.size, t.n AS source_size, t.target, t.i, round(t.target)::BIGINT AS whole,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (
  SELECT *, greatest(0, least(size, whole - start)) AS a, greatest(0, least(size, whole - start - source_size)) AS b
  FROM p),
u AS (SELECT *, CASE WHEN target > 0 THEN least((start + CASE WHEN a > 0 THEN 0 ELSE source_size END) / target, 1) ELSE 0 END AS x FROM q)
SELECT doc_id, size, source_size, target, (a + b)::BIGINT AS taken, start, ((a > 0)::INT + (b > 0)::INT)::INT AS n_readings,
       CASE WHEN a + b > 0 THEN round(CASE
         WHEN i % 3 = 0 THEN 2 * x / (1.5 + sqrt(2.25 - 2 * x))
         WHEN i % 3 = 1 THEN 2 * x / (0.5 + sqrt(0.25 + 2 * x))
         WHEN x < 0.55 THEN 2 * x / (0.8 + sqrt(0.64 + 2.4 * x))
         ELSE 0.5 + 2 * (x - 0.55) / (1.4 + sqrt(1.96 - 4 * (x - 0.55))) END, 6) END AS position
FROM u
"""

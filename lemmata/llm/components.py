"""Connected components of a graph given as an edge table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


class Forest:
    """Union-find over any hashable names; the smaller root wins."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        path = []
        while (y := self.up.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            self.up[p] = x
        return x

    def join(self, a, b) -> bool:
        """Whether the two were apart."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for every node of ``edges`` (a, b), the component being
    its smallest node.

    Each round joins every node with the first among itself and its neighbours,
    in an order drawn anew, and only edges between what is still apart go on to
    the next. So what rounds read falls by a constant factor, of long chains
    and dense groups alike, and all of them read a small multiple of the edges.
    Each round's tables are written."""
    pair = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    pair, steps = written(pair, "edges"), []
    while not pair.isEmpty():
        if len(steps) == rounds:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
        place = [F.struct(F.xxhash64(F.lit(len(steps)), c).alias("h"), F.col(c).alias("id")) for c in ("a", "b")]
        ends = pair.select(F.explode(F.array(*(F.struct(F.col(c).alias("id"), F.least(*place).alias("first")) for c in ("a", "b")))).alias("e"))
        step = written(ends.groupBy("e.id").agg(F.min("e.first")["id"].alias("to")), "labels")
        steps.append(step)
        moved = pair.join(step.select(F.col("id").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("id").alias("b"), F.col("to").alias("y")), "b").where("x <> y")
        pair = written(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not steps:
        return pair.select(F.col("a").alias("id"), F.col("b").alias("component"))
    last = steps.pop()
    while steps:
        further = last.select(F.col("id").alias("to"), F.col("to").alias("further"))
        last = steps.pop().join(further, "to", "left").select("id", F.coalesce("further", "to").alias("to"))
    last = written(last, "labels")
    least = last.groupBy("to").agg(F.min("id").alias("component"))
    return written(last.join(least, "to").select("id", "component"), "components")


def forest_edges(pairs: np.ndarray) -> list[tuple]:
    """A spanning forest of the given pairs."""
    f = Forest()
    return [(a, b) for a, b in pairs.tolist() if f.join(a, b)]

"""Helpers for tests of rules."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from statistics import fmean, pstdev

from pyspark.sql import DataFrame


def bag(df: DataFrame) -> Counter:
    """Rows as a multiset of sorted (column, value) pairs."""
    return Counter(tuple(sorted(r.asDict(recursive=True).items(), key=lambda x: x[0])) for r in df.collect())


def rows(*dicts: dict) -> Counter:
    """The multiset that ``bag`` would give of these rows."""
    return Counter(tuple(sorted(d.items())) for d in dicts)


def timed(run: Callable[[], object], times: int = 5) -> tuple[float, float]:
    """Mean and standard deviation of the seconds that ``run`` takes."""
    took = []
    for _ in range(times):
        t = time.perf_counter()
        run()
        took.append(time.perf_counter() - t)
    return fmean(took), pstdev(took)

"""Accumulators: what a group of facts is reduced to.

Each has an ``initial`` value, which decides whether a match without facts
counts, and builds one aggregate Column. ``present`` marks rows that hold a
fact, as an outer join also yields rows without one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .expr import Expr, Field, Scope, expr
from .expr import from_data as expr_from_data

Build = Callable[[Scope, Column], Column]


@dataclass(frozen=True)
class Accumulator:
    """``build`` gives the aggregate; ``empty`` what no facts give, or None if
    they give nothing; ``used`` the fields that are read. With ``merge``, an
    aggregate over results of ``build``, a group may be reduced in parts."""

    name: str
    build: Build
    empty: Callable[[], Column] | None = None
    used: frozenset = frozenset()
    whole: bool = False
    finish: Callable[[Column], Column] | None = None
    data: tuple = ()
    merge: Callable[[Column], Column] | None = None

    def with_finish(self, fn: Callable[[Column], Column]) -> Accumulator:
        """The same reduction with another conversion of its result."""
        return replace(self, finish=fn, data=())

    def column(self, scope: Scope, present: Column) -> Column:
        return self.finished(self.build(scope, present))

    def finished(self, out: Column) -> Column:
        return self.finish(out) if self.finish else out

    def nothing(self) -> Column | None:
        if self.empty is None:
            return None
        return self.finish(self.empty()) if self.finish else self.empty()


def _by(x) -> Expr:
    return Field(x) if isinstance(x, str) else expr(x)


def _only(present: Column, c: Column) -> Column:
    return F.when(present, c)


def _reader(by: Expr) -> dict:
    return {"used": by.fields(), "whole": by.uses_this()}


def min_(field, returns_fact: bool = False) -> Accumulator:
    by = _by(field)
    if returns_fact:
        return Accumulator("min", lambda s, p: F.min(_only(p & by.column(s).isNotNull(), F.struct(by.column(s).alias("k"), s.this().alias("fact"))))["fact"], None, by.fields(), True, data=("min", field, True))
    return Accumulator("min", lambda s, p: F.min(_only(p, by.column(s))), None, **_reader(by), data=("min", field, False))


def max_(field, returns_fact: bool = False) -> Accumulator:
    by = _by(field)
    if returns_fact:
        return Accumulator("max", lambda s, p: F.max(_only(p & by.column(s).isNotNull(), F.struct(by.column(s).alias("k"), s.this().alias("fact"))))["fact"], None, by.fields(), True, data=("max", field, True))
    return Accumulator("max", lambda s, p: F.max(_only(p, by.column(s))), None, **_reader(by), data=("max", field, False))


def average(field) -> Accumulator:
    by = _by(field)
    return Accumulator("average", lambda s, p: F.avg(_only(p, by.column(s))), None, **_reader(by), data=("average", field))


def sum_(field) -> Accumulator:
    by = _by(field)
    return Accumulator("sum", lambda s, p: F.coalesce(F.sum(_only(p, by.column(s))), F.lit(0)), lambda: F.lit(0), **_reader(by), data=("sum", field))


def count() -> Accumulator:
    return Accumulator("count", lambda s, p: F.count(_only(p, F.lit(1))), lambda: F.lit(0).cast("long"), data=("count",))


def exists() -> Accumulator:
    return Accumulator("exists", lambda s, p: F.max(_only(p, F.lit(True))), None, data=("exists",))


def _list(s: Scope, p: Column, c: Column, aggregate=F.collect_list) -> Column:
    # inside a struct null stays; the order is by value, so that reruns agree
    return F.array_sort(aggregate(_only(p, F.struct(c.alias("x")))))["x"]


def all_(field=None) -> Accumulator:
    """Every fact, or every value of ``field``, as a sorted array."""
    by = _by(field) if field is not None else None
    read = _reader(by) if by is not None else {"whole": True}
    return Accumulator("all", lambda s, p: _list(s, p, by.column(s) if by is not None else s.this()), lambda: F.array(), **read, data=("all", field))


def distinct(field=None) -> Accumulator:
    """The different facts, or values of ``field``, as a sorted array."""
    by = _by(field) if field is not None else None
    read = _reader(by) if by is not None else {"whole": True}
    return Accumulator("distinct", lambda s, p: _list(s, p, by.column(s) if by is not None else s.this(), F.collect_set), lambda: F.array(), **read, data=("distinct", field))


def _given(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` names it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def grouping_by(field, convert: Callable[[Column], Column] | None = None) -> Accumulator:
    """Facts by value of ``field``: an array of (key, items), sorted by key;
    ``convert`` is applied to it."""
    by = _by(field)

    def build(s: Scope, p: Column) -> Column:
        pairs = F.array_sort(F.collect_list(_only(p, F.struct(by.column(s).alias("key"), s.this().alias("item")))))

        def runs(pairs):
            """A run of each key, cut out of the sorted pairs."""
            first = lambda e, i: (i == 0) | ~F.get(pairs, i - 1)["key"].eqNullSafe(e["key"])
            starts = F.filter(F.transform(pairs, lambda e, i: F.when(first(e, i), i)), lambda i: i.isNotNull())
            return _given(F.concat(starts, F.array(F.size(pairs))), cut(pairs))

        def cut(pairs):
            run = lambda ends: lambda i, k: F.slice(pairs, i + 1, F.get(ends, k + 1) - i)
            of = lambda x: F.struct(F.get(x, F.lit(0))["key"].alias("key"), x["item"].alias("items"))
            return lambda ends: F.transform(F.transform(F.slice(ends, 1, F.size(ends) - 1), run(ends)), of)

        return _given(pairs, runs)

    return Accumulator("grouping_by", build, lambda: F.array(), by.fields(), True, convert, ("grouping_by", field) if convert is None else ())


def accum(initial, reduce: Callable[[Column, Column], Column], finish: Callable[[Column], Column] | None = None, field=None, empty: bool = True, combine: Callable[[Column, Column], Column] | None = None) -> Accumulator:
    """A reduction by Column functions over the facts, or values of ``field``,
    in sorted order. ``initial`` is a value or a function that gives a Column;
    without it the first value starts the reduction and no facts give nothing.
    With ``combine``, which makes one of two results in any order and for which
    ``initial`` is neutral, each partition reduces its share of a group first,
    so that no list holds a whole group."""
    by = _by(field) if field is not None else None
    read = _reader(by) if by is not None else {"whole": True}

    def over(items: Column, fn: Callable[[Column, Column], Column]) -> Column:
        if initial is None:
            return _given(items, lambda x: F.when(F.size(x) > 0, F.aggregate(F.slice(x, 2, F.greatest(F.size(x), F.lit(1))), F.get(x, F.lit(0)), fn)))
        return F.aggregate(items, begin(), fn)

    def build(s: Scope, p: Column) -> Column:
        return over(_list(s, p, by.column(s) if by is not None else s.this()), reduce)

    begin = initial if callable(initial) else lambda: F.lit(initial)
    merge = (lambda c: over(F.array_sort(F.collect_list(c)), combine)) if combine else None
    return Accumulator("accum", build, begin if initial is not None and empty else None, **read, finish=finish, merge=merge)


def accum_python(fn: Callable[[list], object], kind: T.DataType | str, field=None, empty=None) -> Accumulator:
    """A reduction by a Python function of the list of facts or values. The
    slow way: prefer ``accum``."""
    by = _by(field) if field is not None else None
    read = _reader(by) if by is not None else {"whole": True}
    run = F.udf(fn, kind, useArrow=True)
    return Accumulator("accum_python", lambda s, p: run(_list(s, p, by.column(s) if by is not None else s.this())), (lambda: F.lit(empty)) if empty is not None else None, **read)


NAMED = {"min": min_, "max": max_, "average": average, "sum": sum_, "count": count, "exists": exists, "distinct": distinct, "all": all_, "grouping_by": grouping_by}


def from_data(d: list) -> Accumulator:
    return NAMED[d[0]](*(expr_from_data(x) if isinstance(x, dict) else x for x in d[1:]))

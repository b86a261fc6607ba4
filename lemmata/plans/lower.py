"""Productions as DataFrames.

A token, a partial match, is a row with a column ``b_<variable>`` for each
variable and ``m_<i>`` with the id of each matched fact, where facts have ids.
Tokens are bags: nothing here removes duplicates that the rules mean to keep.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import Scope, as_column, every
from .model import Acc, Cond, Query, RuleError, Test
from .normalize import analyse, conjunctions, exported, mentioned, ordered

FID = "__fid"
#: facts(type, condition number) -> DataFrame
Facts = Callable[[str, int], DataFrame]


class Lowering:
    """Lowers conditions against the facts of one moment. Prefixes that several
    productions share are lowered once, as the same DataFrame."""

    def __init__(self, spark: SparkSession, facts: Facts, lineage: bool = False, strict: bool = False):
        self.spark, self.facts, self.lineage, self.strict = spark, facts, lineage, strict
        self.known: dict[tuple, DataFrame] = {}
        self.serial = 0

    def unit(self) -> DataFrame:
        """One token without bindings."""
        return self.spark.range(1).select()

    def tokens(self, when: tuple) -> list[DataFrame]:
        """Tokens of each conjunction of a left-hand side."""
        return [self.conjunction(ordered(c)) for c in conjunctions(when)]

    def conjunction(self, conditions: list, start: DataFrame | None = None, first: int = 0) -> DataFrame:
        key: tuple = ()
        out = start
        for i, c in enumerate(conditions):
            key = (*key, (first + i, c.key()))
            if start is None and key in self.known:
                out = self.known[key]
                continue
            out = self.step(out, c, first + i)
            if start is None:
                self.known[key] = out
        return self.unit() if out is None else out

    # one condition

    def step(self, tokens: DataFrame | None, c, i: int) -> DataFrame:
        if isinstance(c, Cond):
            return self.positive(tokens, c, i)
        if isinstance(c, Test):
            base = self.unit() if tokens is None else tokens
            for e in c.exprs:
                base = base.where(e.lowered(_on_tokens("a test" if self.strict else None)))
            return base
        if isinstance(c, Acc):
            return self.accumulate(tokens, c, i)
        if c.op == "exists":
            return self.exists(tokens, c.parts[0], i)
        if c.op == "not":
            return self.negation(tokens, c.parts[0], i)
        raise RuleError(f"cannot lower {c.op}")

    def candidates(self, c: Cond, i: int, whole: bool = False, extra: frozenset = frozenset(), alone: bool = False):
        """Facts that pass the local constraints: columns ``c_<variable>``, and
        ``x_<field>`` for fields that later steps read; as tokens if ``alone``."""
        self.serial += 1
        a = analyse(c)
        facts = self.facts(c.type, i)
        names = [n for n in facts.columns if not n.startswith("__")]
        argument = dict(c.args)
        local: dict[str, Column | str] = {}

        def field(name: str) -> Column | str:
            if name in argument:
                return argument[name].lowered(Scope(_quoted, _none, lambda: as_column(fact())))
            if name == FID and FID in facts.columns:
                return FID
            if name not in names:
                raise RuleError(f"{c.type} has no field {name}")
            return _quoted(name)

        def fact() -> str:
            return f"struct({', '.join(map(_quoted, names))})"

        scope = Scope(field, lambda n: local[n], lambda: as_column(fact()), f"a condition on {c.type}" if self.strict else None)
        if c.bind:
            local[c.bind] = fact()
        passed: list[Column | str] = []
        for name, e in a.local:
            if name is None:
                passed.append(e.lowered(scope))
            elif name in local:
                passed.append(_same(local[name], e.lowered(scope)))
            else:
                local[name] = e.lowered(scope)
        later = frozenset().union(*(e.fields() for _, e in a.joined)) if a.joined else frozenset()
        keep = [(field(n), f"x_{n}") for n in sorted(later | extra)]
        if whole or any(e.uses_this() for _, e in a.joined):
            keep.append((fact(), "__this"))
        out = facts.where(every(passed)) if passed else facts
        if alone:
            return a, chosen(out, [*((local[n], f"b_{n}") for n in a.binds), *([(FID, f"m_{i}")] if self.lineage and FID in facts.columns else [])])
        if FID in facts.columns:
            keep.append((FID, "__id"))
        return a, chosen(out, [*((local[n], f"c_{n}") for n in a.binds), *keep, ("true", "__here")])

    def matched(self, tokens: DataFrame | None, a, cand: DataFrame):
        """Join keys, join predicate, and columns that the join creates."""
        have = {n[2:] for n in (tokens.columns if tokens is not None else ()) if n.startswith("b_")}
        keys = [n for n in a.binds if n in have]
        scope = Scope(lambda n: f"`x_{n}`", lambda n: made[n] if n in made else f"`c_{n}`" if n in a.binds and n not in have else f"`b_{n}`", lambda: F.col("__this"), "a join filter" if self.strict else None)
        made: dict[str, Column | str] = {}
        on: list[Column | str] = [_same(f"`b_{n}`", f"`c_{n}`") for n in keys]
        for name, e in a.joined:
            value = e.lowered(scope)
            if name is None:
                on.append(value)
            elif name in have:
                on.append(_same(f"`b_{name}`", value))
            elif name in made:
                on.append(_same(made[name], value))
            elif name in a.binds:
                on.append(_same(f"`c_{name}`", value))
            else:
                made[name] = value
        new = [n for n in a.binds if n not in have]
        return keys, new, made, as_column(every(on)) if on else None

    def positive(self, tokens: DataFrame | None, c: Cond, i: int) -> DataFrame:
        if tokens is None and not analyse(c).joined:
            return self.candidates(c, i, alone=True)[1]
        a, cand = self.candidates(c, i)
        if a.needs and tokens is None:
            raise RuleError(f"unbound variables: {', '.join(sorted(a.needs))}")
        keys, new, made, on = self.matched(tokens, a, cand)
        if tokens is None:
            joined = cand if on is None else cand.where(on)
            old = []
        else:
            joined = tokens.crossJoin(cand) if on is None else tokens.join(cand, on, "inner")
            old = [(_quoted(n), n) for n in tokens.columns]
        ids = [("__id", f"m_{i}")] if self.lineage and "__id" in cand.columns else []
        return chosen(joined, [*old, *((f"`c_{n}`", f"b_{n}") for n in new), *((e, f"b_{n}") for n, e in made.items()), *ids])

    def negation(self, tokens: DataFrame | None, c, i: int) -> DataFrame:
        base = self.unit() if tokens is None else tokens
        if isinstance(c, Test):
            passed = F.lit(True)
            for e in c.exprs:
                passed = passed & F.coalesce(e.column(_on_tokens()), F.lit(False))
            return base.where(~passed)
        if isinstance(c, Cond):
            a, cand = self.candidates(c, i)
            _, _, _, on = self.matched(base, a, cand)
            if on is None:
                return base.join(cand.select("__here").limit(1), F.lit(True), "left_anti")
            return base.join(cand, on, "left_anti")
        have = {n[2:] for n in base.columns if n.startswith("b_")}
        shared = sorted(have & mentioned(c))
        start = base.select(*(F.col(f"`b_{n}`") for n in shared)).distinct() if shared else None
        subs = []
        for conj in conjunctions((c,)):
            sub = self.conjunction(ordered(conj, frozenset(shared)), start if start is not None else self.unit(), 1000 * (i + 1))
            subs.append(sub.select(*(F.col(f"`b_{n}`").alias(f"s_{n}") for n in shared), F.lit(True).alias("__here")))
        sub = subs[0]
        for s in subs[1:]:
            sub = sub.unionByName(s)
        if not shared:
            return base.join(sub.limit(1), F.lit(True), "left_anti")
        on = None
        for n in shared:
            k = F.col(f"`b_{n}`").eqNullSafe(F.col(f"`s_{n}`"))
            on = k if on is None else on & k
        return base.join(sub, on, "left_anti")

    def exists(self, tokens: DataFrame | None, c: Cond, i: int) -> DataFrame:
        base = self.unit() if tokens is None else tokens
        a, cand = self.candidates(c, i)
        keys, new, made, on = self.matched(base, a, cand)
        if not new and not made:
            if on is None:
                return base.join(cand.select("__here").limit(1), F.lit(True), "left_semi")
            return base.join(cand, on, "left_semi")
        if not a.joined:
            few = cand.select(*(F.col(f"`c_{n}`") for n in (*keys, *new))).distinct()
            joined = few if tokens is None else base.crossJoin(few) if on is None else base.join(few, on)
            return joined.select(*(F.col(f"`{n}`") for n in base.columns), *(F.col(f"`c_{n}`").alias(f"b_{n}") for n in new))
        vars_ = [n for n in base.columns if n.startswith("b_")]
        pairs = base.select(*(F.col(f"`{n}`") for n in vars_)).distinct().join(cand, on if on is not None else F.lit(True))
        found = pairs.select(*(F.col(f"`{n}`").alias(f"s_{n}") for n in vars_), *(F.col(f"`c_{n}`").alias(f"n_{n}") for n in new), *(as_column(e).alias(f"n_{n}") for n, e in made.items())).distinct()
        return _attach(base, found, vars_).select(*(F.col(f"`{n}`") for n in base.columns), *(F.col(f"`n_{n}`").alias(f"b_{n}") for n in (*new, *made)))

    def accumulate(self, tokens: DataFrame | None, c: Acc, i: int) -> DataFrame:
        acc, source = c.accumulator, c.source
        a, cand = self.candidates(source, i, acc.whole, acc.used)
        base = self.unit() if tokens is None else tokens
        keys, new, made, on = self.matched(base, a, cand)
        if made:
            raise RuleError(f"a join filter of an accumulator cannot bind {', '.join(made)}")
        fields = Scope(lambda n: f"`x_{n}`", _none, lambda: F.col("__this"))
        used = [F.collect_list(F.when(F.col("__here"), F.col("__id"))).alias("__used")] if self.lineage and "__id" in cand.columns else []
        outer = not new and acc.empty is not None
        old = [(_quoted(n), n) for n in base.columns]
        ids = [("__used", f"a_{i}")] if used else []
        if not a.joined:
            # facts are reduced once for each group, before they meet tokens
            groups = _reduced(cand, [f"c_{n}" for n in (*keys, *new)], acc, fields, used)
            if tokens is None:
                joined = groups
            elif on is None:
                joined = base.crossJoin(groups)
            else:
                joined = base.join(groups, on, "left" if outer else "inner")
        else:
            # facts that a token's predicate lets through; equal tokens are reduced once
            vars_ = [n for n in base.columns if n.startswith("b_")]
            few = base.select(*(F.col(f"`{n}`") for n in vars_)).distinct()
            pairs = few.join(cand, on, "left" if outer else "inner")
            groups = _reduced(pairs, [*vars_, *(f"c_{n}" for n in new)], acc, fields, used)
            groups = groups.select(*(F.col(f"`{n}`").alias(f"s_{n}") for n in vars_), *(F.col(f"`c_{n}`") for n in new), "__value", *(["__used"] if used else []))
            joined = _attach(base, groups, vars_)
        result: Column | str = "__value"
        if outer:
            result = F.coalesce(F.col("__value"), acc.nothing().cast(joined.schema["__value"].dataType))
        unify = c.result is not None and f"b_{c.result}" in base.columns + [f"b_{n}" for n in new]
        into = f"b_{c.result}" if c.result is not None and not unify else "__result"
        out = chosen(joined, [*old, *((f"`c_{n}`", f"b_{n}") for n in new), (result, into), *ids]).where(f"`{into}` IS NOT NULL")
        if c.result is None:
            return out.drop("__result")
        return out.where(_same(f"`b_{c.result}`", "__result")).drop("__result") if unify else out

    # productions

    def query(self, q: Query, params: dict | None = None) -> DataFrame:
        """All variables of a query's matches, one column each."""
        names = sorted(set().union(*(exported(c) for conj in conjunctions(q.when) for c in conj)) if q.when else set())
        out = None
        for tokens in self.tokens(q.when):
            part = chosen(tokens, [(f"`b_{n}`", n) for n in names if f"b_{n}" in tokens.columns])
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        for n, value in (params or {}).items():
            out = out.where(F.col(f"`{n}`").eqNullSafe(F.lit(value)))
        return out


def _reduced(facts: DataFrame, by: list[str], acc, fields: Scope, used: list[Column]) -> DataFrame:
    """Facts by ``by`` with an accumulator's result; first by partition, where
    it can merge results."""
    keys = [F.col(f"`{n}`") for n in by]
    if acc.merge is None:
        return facts.groupBy(*keys).agg(acc.column(fields, F.col("__here")).alias("__value"), *used)
    parts = facts.groupBy(*keys, F.spark_partition_id().alias("__part")).agg(acc.build(fields, F.col("__here")).alias("__value"), *used)
    return parts.groupBy(*keys).agg(acc.finished(acc.merge(F.col("__value"))).alias("__value"), *([F.flatten(F.collect_list("__used")).alias("__used")] if used else []))


def inserted(tokens: DataFrame, t, columns: list[str], types: dict, keep: list[str] = ()) -> DataFrame:
    """The facts that one insertion makes of each token, in the type's columns."""
    scope = _on_tokens()
    rows = tokens
    if t.each:
        name, e = t.each
        rows = rows.select("*", F.posexplode(e.column(scope)).alias("__at", f"b_{name}"))
    elif "__at" in keep:
        rows = rows.withColumn("__at", F.lit(0))
    if t.when is not None:
        rows = rows.where(t.when.lowered(scope))
    given = dict(t.columns)
    if unknown := set(given) - set(columns):
        raise RuleError(f"{t.type} has no field {', '.join(sorted(unknown))}")
    return chosen(rows, [*((_cast(given[c].lowered(scope) if c in given else "NULL", types[c]), c) for c in columns), *((_quoted(c), c) for c in keep)])


def chosen(df: DataFrame, columns: list) -> DataFrame:
    """A selection of (Column or SQL text, name)."""
    if all(isinstance(x, str) for x, _ in columns):
        return df.selectExpr(*(f"{x} AS `{n}`" for x, n in columns))
    return df.select(*(as_column(x).alias(n) for x, n in columns))


def _quoted(name: str) -> str:
    return f"`{name}`"


def _same(a: Column | str, b: Column | str) -> Column | str:
    if isinstance(a, str) and isinstance(b, str):
        return f"({a} <=> {b})"
    return as_column(a).eqNullSafe(as_column(b))


def _cast(x: Column | str, kind: T.DataType) -> Column | str:
    if isinstance(x, str) and isinstance(kind, T.AtomicType):
        return f"CAST({x} AS {kind.simpleString()})"
    return as_column(x).cast(kind)


def _none(name: str) -> Column:
    raise RuleError(f"unbound variable ?{name}")


def _on_tokens(strict: str | None = None) -> Scope:
    return Scope(_none, lambda n: f"`b_{n}`", None, strict)


def _attach(base: DataFrame, found: DataFrame, vars_: list[str]) -> DataFrame:
    on = None
    for n in vars_:
        k = F.col(f"`{n}`").eqNullSafe(F.col(f"`s_{n}`"))
        on = k if on is None else on & k
    return base.crossJoin(found) if on is None else base.join(found, on)


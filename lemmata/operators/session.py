"""Immutable sessions over a rulebase.

Inserting and retracting return a new session and change nothing until it is
fired. Firing evaluates by the rulebase's mode: one lazy plan for acyclic rules
with logical insertions only, in which recomputing is truth maintenance; a
semi-naive loop for monotone recursion; an agenda loop for everything else.

Within one plan a derived type that at least ``shared`` conditions read is
stored once, so that chains of such types do not multiply their work.
"""

from __future__ import annotations

from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lower import FID, Lowering, inserted
from ..plans.model import Query, RuleError
from ..plans.stratify import descendants, read_types, strata
from .agenda import Agenda, State
from .recursion import closed
from .rulebase import Rulebase, schema_of
from .store import netted, stored, without


@dataclass(frozen=True)
class Session:
    rulebase: Rulebase
    spark: SparkSession
    base: dict = field(default_factory=dict)
    pending: tuple = ()
    state: State | None = None
    serial: int = 0
    max_cycles: int = 600
    listeners: tuple = ()
    strict: bool = False
    shared: int = 4
    full: bool = False
    on_limit: object = "raise"
    cache: dict = field(default_factory=dict, compare=False, repr=False)

    # facts in and out

    def insert(self, type: str, facts) -> Session:
        """Queues facts: a DataFrame, or rows as tuples or dicts."""
        return replace(self, pending=(*self.pending, ("insert", type, self._frame(type, facts))), cache={})

    def retract(self, type: str, facts) -> Session:
        """Queues the removal of one equal instance for each given fact."""
        return replace(self, pending=(*self.pending, ("retract", type, self._frame(type, facts))), cache={})

    def _frame(self, type: str, facts) -> DataFrame:
        if type not in self.rulebase.types:
            raise RuleError(f"unknown fact type {type}")
        schema = schema_of(self.rulebase.types[type])
        if not isinstance(facts, DataFrame):
            facts = self.spark.createDataFrame(list(facts), schema)
        return facts.select(*(F.col(f"`{c.name}`").cast(c.dataType).alias(c.name) for c in schema.fields))

    def empty(self, type: str) -> DataFrame:
        return self.spark.createDataFrame([], schema_of(self.rulebase.types[type]))

    def with_listener(self, listener) -> Session:
        """``listener(event, rule, what)`` is called as rules fire. A lazy plan
        has no events, so a session with listeners runs the agenda loop, and
        what it derived before is fired anew as it is taken over."""
        return replace(self, listeners=(*self.listeners, listener))._taken_over(self)

    def with_full_logging(self) -> Session:
        """Every activation that ever fires is kept, see
        ``tools.inspect.activations_fired``; needs the agenda loop too."""
        return replace(self, full=True)._taken_over(self)

    def with_loop_detection(self, max_cycles: int, on_limit="raise") -> Session:
        """``on_limit``: ``raise``, ``print`` or a function of the cycles and
        the rules that were active last."""
        return replace(self, max_cycles=max_cycles, on_limit=on_limit)

    def _taken_over(self, before: Session) -> Session:
        return self._identified() if before.mode != "agenda" and self.base else self

    def without_listener(self, listener) -> Session:
        return replace(self, listeners=tuple(x for x in self.listeners if x is not listener))

    # firing

    @property
    def mode(self) -> str:
        """The rulebase's mode, or ``agenda`` once there is state to keep or
        events are wanted."""
        return "agenda" if self.state is not None or self.listeners or self.full else self.rulebase.mode

    def _agenda(self, base: dict, state: State) -> Agenda:
        return Agenda(self.rulebase, self.spark, base, state, self.max_cycles, self.listeners, self.strict, self.full, self.on_limit)

    def _identified(self) -> Session:
        """The session as the agenda loop keeps it. Retracting facts that rules
        inserted needs it: a plan would derive them again."""
        base = {t: stored(df.withColumn(FID, F.xxhash64(F.lit(-1 - i), F.monotonically_increasing_id()))) for i, (t, df) in enumerate(self.base.items())}
        base, state = self._agenda(base, State()).run()
        return replace(self, base=base, state=state, cache={})

    def fire(self, cancelling: bool = False) -> Session:
        """Applies what is queued, in order, and runs the rules. ``cancelling``
        nets insertions against retractions of equal facts first and then
        inserts before it retracts."""
        ops = self._netted() if cancelling else list(self.pending)
        made = {t.type for r in self.rulebase.rules for t in r.then if hasattr(t, "type")}
        if self.mode != "agenda" and any(kind == "retract" and type in made for kind, type, _ in ops):
            return self._identified().fire(cancelling)
        ids = self.mode == "agenda"
        base, serial = dict(self.base), self.serial
        state = self.state or State()
        for kind, type, facts in ops:
            serial += 1
            if ids and kind == "insert":
                facts = stored(facts.withColumn(FID, F.xxhash64(F.lit(serial), F.monotonically_increasing_id())))
            have = base.get(type)
            if kind == "insert":
                base[type] = facts if have is None else have.unionByName(facts)
                continue
            if ids and type in state.derived:
                # an instance that a rule inserted may be the one to go
                left = stored(without(state.derived[type], without_given(facts, have)))
                state = replace(state, derived=state.derived | {type: left})
            if have is not None:
                base[type] = stored(without(have, facts)) if ids else without(have, facts)
        out = replace(self, base=base, pending=(), serial=serial, cache={})
        if not ids:
            return out
        base, state = self._agenda(base, state).run()
        return replace(out, base=base, state=state)

    def _netted(self) -> list:
        out = []
        for type in dict.fromkeys(t for _, t, _ in self.pending):
            added, removed = self.empty(type), self.empty(type)
            for kind, t, facts in self.pending:
                if t == type and kind == "insert":
                    added = added.unionByName(facts)
                elif t == type:
                    removed = removed.unionByName(facts)
            more, less = netted(added, removed, self.empty(type))
            out += [("insert", type, more), ("retract", type, less)]
        return sorted(out, key=lambda x: x[0] == "retract")

    # reading

    def lowering(self, lineage: bool = False) -> Lowering:
        """Lowers productions against the facts after the last firing."""
        key = ("lowering", lineage)
        if key not in self.cache:
            if self.mode == "agenda":
                facts = Agenda(self.rulebase, self.spark, self.base, self.state or State(), self.max_cycles, ()).facts
            else:
                facts = self._derived()
            self.cache[key] = Lowering(self.spark, lambda t, i: facts(t), lineage, self.strict)
        return self.cache[key]

    def _derived(self):
        """Facts of a type with all that the rules derive, as lazy plans. A plan
        is built when a type is first asked for, with what it rests on only;
        ``facts.ready`` builds those of several types, side by side where they
        do not rest on each other."""
        if "derived" in self.cache:
            return self.cache["derived"]
        types, rules = self.rulebase.types, self.rulebase.rules
        below = descendants(types)
        derived: dict[str, DataFrame] = {}
        memo: dict[str, DataFrame] = {}
        groups = strata(rules, types)
        place = {t: i for i, group in enumerate(groups) for t in group}
        makers: list[list] = [[] for _ in groups]
        for r in rules:
            for t in r.then:
                makers[place[t.type]].append((r, t))
        rests = [{s for t in group for s in _reads(m, below, t)} for group, m in zip(groups, makers, strict=True)]
        done: set[int] = set()
        readers = self._readers(below)
        above: dict[str, set[str]] = {t: {t} for t in place}
        for a, ts in below.items():
            for t in ts:
                above.setdefault(t, {t}).add(a)
        # these run jobs
        eager = {i for i, group in enumerate(groups) if rests[i] & group or any(readers[t] >= self.shared for t in group)}

        def own(type: str) -> DataFrame:
            out = self.base.get(type)
            if type in derived:
                out = derived[type] if out is None else out.unionByName(derived[type])
            if out is not None:
                return out
            # types of one schema share one table without facts
            schema = types[type].schema
            key = ("empty", schema if isinstance(schema, str) else schema.json())
            if key not in self.cache:
                self.cache[key] = self.empty(type)
            return self.cache[key]

        def facts(type: str) -> DataFrame:
            if type not in memo:
                ready([type])
                memo[type] = upcast(types, type, {t: own(t) for t in below.get(type, [type])})
            return memo[type]

        def ready(wanted: list[str], run=None) -> None:
            todo, need = list(wanted), set()
            while todo:
                for t in below.get(t0 := todo.pop(), [t0]):
                    i = place.get(t)
                    if i is not None and i not in need and i not in done:
                        need.add(i)
                        todo += rests[i]
            levels: dict[int, list[int]] = {}
            level: dict[int, int] = {}
            for i in sorted(need):  # what a group rests on comes before it
                under = {place[d] for t in rests[i] for d in below.get(t, [t]) if d in place} - {i}
                level[i] = 1 + max((level[j] for j in under if j in level), default=-1)
                levels.setdefault(level[i], []).append(i)
            for n in sorted(levels):
                done.update(levels[n])
                lazy = [i for i in levels[n] if i not in eager]
                for i in levels[n]:
                    if run is None or i in eager:
                        derive(i)
                if run is not None:
                    run(derive, lazy)

        def derive(i: int) -> None:
            group = groups[i]
            if rests[i] & set(group):
                derived.update(closed(self, group, makers[i], facts, below))
            else:
                lower = Lowering(self.spark, lambda t, i: facts(t), strict=self.strict)
                parts: dict[str, list] = {}
                for r, t in makers[i]:
                    cols = self.rulebase.columns(t.type)
                    for tokens in lower.tokens(r.when):
                        parts.setdefault(t.type, []).append(inserted(tokens, t, [c for c, _ in cols], dict(cols)))
                for t, frames in parts.items():
                    out = frames[0]
                    for f in frames[1:]:
                        out = out.unionByName(f)
                    derived[t] = stored(out) if readers[t] >= self.shared else out
            for t in group:
                for a in above[t]:
                    memo.pop(a, None)

        facts.ready = ready
        self.cache["derived"] = facts
        return facts

    def _readers(self, below: dict) -> Counter:
        """How many conditions of rules and queries read facts of each type."""
        every = (*self.rulebase.rules, *self.rulebase.queries.values())
        return Counter(d for p in every for c in p.when for t, _ in read_types(c) for d in below.get(t, [t]))

    def facts(self, type: str) -> DataFrame:
        """All facts of a type and of those below it after the last firing."""
        df = self.lowering().facts(type, 0)
        return df.drop(*(c for c in df.columns if c.startswith("__") and c != "__unit"))

    def query(self, q: str | Query, **params) -> DataFrame:
        """The bag of a query's matches, a column for each variable."""
        name = q.name if isinstance(q, Query) else q
        if name not in self.rulebase.queries:
            raise RuleError(f"unknown query {name}")
        found = self.rulebase.queries[name]
        given = {k.removeprefix("?"): x for k, x in params.items()}
        if set(given) != set(found.params):
            raise RuleError(f"query {name} takes parameters {sorted(found.params)}, not {sorted(given)}")
        return self.lowering().query(found, given)

    def planned(self, names=None, threads: int = 4) -> dict[str, DataFrame]:
        """Several queries without parameters, or all of them, with their plans
        built by ``threads`` threads."""
        found = [self.rulebase.queries[n] for n in (self.rulebase.queries if names is None else names)]
        if any(q.params for q in found):
            raise RuleError("a query with parameters has no plan by itself")
        lower = self.lowering()
        with ThreadPoolExecutor(threads) as pool:

            def run(fn, items) -> list:
                # some items to a thread, as each thread has its own way into the JVM
                parts = [items[k::threads] for k in range(threads)]
                waits = [pool.submit(inheritable_thread_target(self.spark)(lambda part=part: [fn(x) for x in part])) for part in parts if part]
                return [x for w in waits for x in w.result()]

            if self.mode != "agenda":
                self._derived().ready([t for q in found for c in q.when for t, _ in read_types(c)], run)
            return dict(run(lambda q: (q.name, lower.query(q)), found))


def _reads(makers, below, type: str) -> set[str]:
    from ..plans.stratify import sources

    return {s for r, t in makers if t.type == type for s, _ in sources(r, below)}


def upcast(types: dict, type: str, frames: dict) -> DataFrame:
    """Facts of a type and of those below it, in the type's own columns, which
    are those of its first table where it has no schema itself."""
    if list(frames) == [type] and type in types:
        return frames[type]
    order = [t for t in frames if t == type] + [t for t in frames if t != type]
    if type in types:
        names = [c.name for c in schema_of(types[type]).fields]
    else:
        first = types[order[0]]
        names = list(first.columns.get(type, {})) or [c.name for c in schema_of(first).fields]
    out = None
    for t in order:
        rename = types[t].columns.get(type, {}) if t != type else {}
        df = frames[t]
        kept = [F.col(f"`{rename.get(n, n)}`").alias(n) for n in names if rename.get(n, n) in df.columns]
        if FID in df.columns:
            kept.append(F.col(FID))
        part = df.select(*kept)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def without_given(facts: DataFrame, have: DataFrame | None) -> DataFrame:
    """Those of ``facts`` that ``have`` holds no equal instance of."""
    if have is None:
        return facts
    cols = [F.col(f"`{c}`") for c in facts.columns]
    return facts.exceptAll(have.select(*cols))

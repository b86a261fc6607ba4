"""The agenda loop: rules by group and order, until nothing changes.

Needed where the outcome depends on the order of firing or on what fired
before: negation or accumulation within a cycle, retractions, unconditional
insertions, no-loop rules and Python actions. All state is tables in the shared
folder. A rule's new activations fire together, as one batch.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lower import FID, Lowering, inserted
from ..plans.model import Action, ActionError, Insert, Rule
from ..plans.stratify import descendants
from ..tools.loops import limited
from .rulebase import Rulebase, schema_of
from .store import stored, values, without

TID = "__tid"


def token_id(*parts) -> Column:
    """128 bits of hash of an activation's parts."""
    return F.concat(F.hex(F.xxhash64(*parts)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), *parts)))


@dataclass(frozen=True)
class State:
    """Facts that rules derived (with the rule and token behind each), tokens
    that fired by rule, events, and, under full logging, every activation that
    ever fired by rule."""

    derived: dict = field(default_factory=dict)
    fired: dict = field(default_factory=dict)
    log: tuple = ()
    history: dict = field(default_factory=dict)


class Agenda:
    def __init__(self, rulebase: Rulebase, spark: SparkSession, base: dict, state: State, max_cycles: int, listeners: tuple, strict: bool = False, full: bool = False, on_limit="raise"):
        self.rulebase, self.spark = rulebase, spark
        self.base, self.derived, self.fired = dict(base), dict(state.derived), dict(state.fired)
        self.log, self.history = list(state.log), dict(state.history)
        self.full, self.on_limit = full, on_limit
        self.max_cycles, self.listeners, self.strict = max_cycles, listeners, strict
        self.below = descendants(rulebase.types)

    # facts

    def empty(self, type: str) -> DataFrame:
        return self.spark.createDataFrame([], schema_of(self.rulebase.types[type])).withColumn(FID, F.lit(0).cast("long"))

    def own(self, type: str) -> DataFrame:
        out = self.base.get(type)
        if type in self.derived:
            d = self.derived[type].drop("__rule", TID)
            out = d if out is None else out.unionByName(d)
        return self.empty(type) if out is None else out

    def facts(self, type: str) -> DataFrame:
        from .session import upcast

        return upcast(self.rulebase.types, type, {t: self.own(t) for t in self.below.get(type, [type])})

    # one rule

    def current(self, r: Rule) -> DataFrame:
        """Activations now: tokens with an id from the rule, the branch, the ids
        of matched facts in order and the bindings, accumulated values among them."""
        lower = Lowering(self.spark, lambda t, i: self.facts(t), lineage=True, strict=self.strict)
        out = None
        for k, tokens in enumerate(lower.tokens(r.when)):
            parts = [F.col(f"`{c}`") for c in sorted(tokens.columns) if not c.startswith("a_")]
            tokens = tokens.withColumn(TID, token_id(F.lit(r.name), F.lit(k), *parts))
            out = tokens if out is None else out.unionByName(tokens, allowMissingColumns=True)
        return stored(out)

    def step(self, r: Rule) -> bool:
        """Fires what is new of a rule and withdraws what no longer holds."""
        now = self.current(r)
        was = self.fired.get(r.name)
        new = now if was is None else now.join(was, TID, "left_anti")
        gone = None if was is None else was.join(now, TID, "left_anti")
        new = stored(new)
        n_new = new.count()
        n_gone = 0
        if gone is not None:
            gone = stored(gone)
            n_gone = gone.count()
        if not n_new and not n_gone:
            return False
        if n_gone:
            self.tell("retract-activations", r.name, n_gone)
            for t in list(self.derived):
                d = self.derived[t]
                self.derived[t] = stored(d.join(gone.withColumn("__rule", F.lit(r.name)), [TID, "__rule"], "left_anti"))
        fired = new.select(TID)
        if was is not None:
            fired = fired.unionByName(was if not n_gone else was.join(gone, TID, "left_anti"))
        self.fired[r.name] = stored(fired)
        if n_new:
            self.tell("fire-activations", r.name, n_new)
            if self.full:
                self.remember(r, new)
            self.apply(r, new)
            if r.no_loop:
                # what its own effects brought about or ended counts as settled
                self.fired[r.name] = stored(self.current(r).select(TID))
        return bool(r.then) and (n_new > 0 or n_gone > 0)

    def remember(self, r: Rule, new: DataFrame) -> None:
        """Keeps activations for good: their number in the order of firing,
        bindings and matched facts."""
        names = [c for c in new.columns if c.startswith("b_")]
        ids = [c for c in sorted(new.columns) if c.startswith("m_")]
        bindings = F.to_json(F.struct(*(F.col(f"`{c}`").alias(c[2:]) for c in names))) if names else F.lit("{}")
        matched = F.array(*(F.col(c) for c in ids)) if ids else F.array().cast("array<long>")
        rows = stored(new.select(F.lit(len(self.log)).alias("step"), F.col(TID).alias("activation"), bindings.alias("bindings"), matched.alias("matched")))
        self.history[r.name] = rows if r.name not in self.history else self.history[r.name].unionByName(rows)

    def apply(self, r: Rule, new: DataFrame) -> None:
        """Unconditional insertions, then logical ones, then retractions."""
        order = sorted(enumerate(r.then), key=lambda x: (not isinstance(x[1], Action), not isinstance(x[1], Insert), isinstance(x[1], Insert) and not x[1].unconditional))
        for k, t in order:
            if isinstance(t, Action):
                names = [c for c in new.columns if c.startswith("b_")]
                for row in new.select(*(F.col(f"`{c}`").alias(c[2:]) for c in names)).toLocalIterator():
                    bindings = row.asDict(recursive=True)
                    try:
                        t.fn(bindings)
                    except Exception as e:
                        raise ActionError(r.name, bindings, e) from e
            elif isinstance(t, Insert):
                cols = self.rulebase.columns(t.type)
                rows = inserted(new, t, [c for c, _ in cols], dict(cols), [TID, "__at"])
                rows = rows.withColumn(FID, F.xxhash64(F.lit(r.name), TID, F.lit(k), "__at")).drop("__at")
                if t.unconditional:
                    rows = stored(rows.drop(TID))
                    self.base[t.type] = rows if t.type not in self.base else self.base[t.type].unionByName(rows)
                else:
                    rows = stored(rows.withColumn("__rule", F.lit(r.name)))
                    self.derived[t.type] = rows if t.type not in self.derived else self.derived[t.type].unionByName(rows)
                self.tell("insert-facts" if t.unconditional else "insert-facts-logical", r.name, t.type)
            else:
                self.remove(r, t, new)

    def remove(self, r: Rule, t, new: DataFrame) -> None:
        cols = self.rulebase.columns(t.type)
        if t.fact:
            gone = new.select(*(F.col(f"`b_{t.fact}`")[c].cast(k).alias(c) for c, k in cols))
        else:
            gone = inserted(new, Insert(t.type, t.columns), [c for c, _ in cols], dict(cols))
        gone = stored(gone)
        if t.type in self.base:
            have = self.base[t.type]
            names = values(have)
            left = gone.exceptAll(have.select(*(F.col(f"`{c}`") for c in names)))
            self.base[t.type] = stored(without(have, gone))
            gone = stored(left)
        if t.type in self.derived:
            self.derived[t.type] = stored(without(self.derived[t.type], gone))
        self.tell("retract-facts", r.name, t.type)

    # the loop

    def run(self) -> tuple[dict, State]:
        groups = self.rulebase.groups()
        cycles, g = 0, 0
        while g < len(groups):
            changed = False
            for r in groups[g]:
                changed |= self.step(r)
            if not changed:
                g += 1
                continue
            cycles += 1
            self.tell("activation-group-transition", None, g)
            if cycles == self.max_cycles + 1:
                limited(self.on_limit, self.max_cycles, sorted({rule for _, rule, _ in self.log[-200:] if rule}))
            g = 0
        return self.base, State(self.derived, self.fired, tuple(self.log), self.history)

    def tell(self, event: str, rule: str | None, what) -> None:
        self.log.append((event, rule, str(what)))
        for listener in self.listeners:
            listener(event, rule, what)


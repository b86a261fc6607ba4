"""Monotone recursion: a semi-naive loop with bag semantics.

Each derivation counts, as each activation inserts its own fact. In every round
each recursive condition in turn reads the last round's facts, those before it
all facts so far and those after it the facts before the last round, so that
every combination is derived once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.lower import Lowering, inserted
from ..plans.model import Cond
from ..plans.normalize import conjunctions, ordered
from .store import stored


def closed(session, group: set[str], makers: list, facts, below: dict) -> dict[str, DataFrame]:
    """Everything derived of the types of ``group``."""
    from .session import upcast

    types, rulebase = session.rulebase.types, session.rulebase
    before = {t: session.base.get(t, session.empty(t)) for t in group}
    delta = {t: None for t in group}
    total: dict[str, DataFrame | None] = dict.fromkeys(group)

    def union(a, b):
        return b if a is None else a if b is None else a.unionByName(b)

    def view(type: str, own: dict) -> DataFrame:
        return upcast(types, type, {t: own[t] if t in group else facts(t) for t in below.get(type, [type])})

    def derive(pick) -> dict[str, DataFrame]:
        """Facts by type, from frames that ``pick`` chooses for each condition;
        it gives the runs to make of a conjunction."""
        out: dict[str, DataFrame] = {}
        for r, t in makers:
            cols = rulebase.columns(t.type)
            for conj in conjunctions(r.when):
                order = ordered(conj)
                inner = [i for i, c in enumerate(order) if isinstance(c, Cond) and set(below.get(c.type, [c.type])) & group]
                for chosen in pick(inner):
                    lower = Lowering(session.spark, lambda type, i, chosen=chosen: view(type, chosen[i]) if i in chosen else facts(type), strict=session.strict)
                    tokens = lower.conjunction(order)
                    out[t.type] = union(out.get(t.type), inserted(tokens, t, [c for c, _ in cols], dict(cols)))
        return out

    # the first round sees the base facts only
    first = derive(lambda inner: [{i: before for i in inner}])
    now = dict(before)
    for round_ in range(session.max_cycles):
        fresh = {t: stored(df) for t, df in (first if round_ == 0 else derive(lambda inner: [{i: now if i < k else delta if i == k else before for i in inner} for k in inner])).items()}
        fresh = {t: df for t, df in fresh.items() if not df.isEmpty()}
        if not fresh:
            return {t: df if df is not None else session.empty(t) for t, df in total.items()}
        before = dict(now)
        delta = {t: fresh.get(t, session.empty(t)) for t in group}
        for t, df in fresh.items():
            total[t] = union(total[t], df)
            now[t] = now[t].unionByName(df)
    from ..tools.loops import LoopError

    raise LoopError(f"recursion did not end in {session.max_cycles} rounds")

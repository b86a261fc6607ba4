"""Which types depend on which, and how a rulebase may be evaluated."""

from __future__ import annotations

from ..plans.model import Acc, Action, Bool, Cond, FactType, Insert, Rule


def read_types(c, positive: bool = True) -> list[tuple[str, bool]]:
    """(type, whether only its presence counts) of a condition's facts."""
    if isinstance(c, Cond):
        return [(c.type, positive)]
    if isinstance(c, Acc):
        return [(c.source.type, False)]
    if isinstance(c, Bool):
        return [t for p in c.parts for t in read_types(p, positive and c.op in ("and", "or"))]
    return []


def descendants(types: dict[str, FactType]) -> dict[str, list[str]]:
    """Each type with itself and the types below it."""

    def above(n: str, seen: tuple = ()) -> set[str]:
        out = {n}
        for p in types[n].parents if n in types and n not in seen else ():
            out |= above(p, (*seen, n))
        return out

    out: dict[str, list[str]] = {n: [] for n in types}
    for n in types:
        for a in above(n):
            out.setdefault(a, []).append(n)
    return out


def sources(r: Rule, below: dict[str, list[str]]) -> set[tuple[str, bool]]:
    return {(d, pos) for c in r.when for t, pos in read_types(c) for d in below.get(t, [t])}


def mode(rules: list[Rule], types: dict[str, FactType]) -> str:
    """"plan" for one lazy plan, "recursion" for monotone cycles, else "agenda"."""
    for r in rules:
        if r.no_loop or any(not isinstance(t, Insert) or t.unconditional or isinstance(t, Action) for t in r.then):
            return "agenda"
    below = descendants(types)
    edges: dict[str, set[tuple[str, bool]]] = {}
    for r in rules:
        for t in r.then:
            edges.setdefault(t.type, set()).update(sources(r, below))
    cyclic = {t for t in edges if t in reach(t, edges)}
    if not cyclic:
        return "plan"
    for t in cyclic:
        for s, pos in edges[t]:
            if not pos and (s == t or t in reach(s, edges)):
                return "agenda"
    return "recursion"


def reach(start: str, edges: dict[str, set[tuple[str, bool]]]) -> set[str]:
    """Types that ``start`` depends on."""
    out: set[str] = set()
    todo = [s for s, _ in edges.get(start, ())]
    while todo:
        t = todo.pop()
        if t not in out:
            out.add(t)
            todo += [s for s, _ in edges.get(t, ())]
    return out


def strata(rules: list[Rule], types: dict[str, FactType]) -> list[set[str]]:
    """Derived types in order of evaluation, cycles together."""
    below = descendants(types)
    edges: dict[str, set[tuple[str, bool]]] = {}
    for r in rules:
        for t in r.then:
            edges.setdefault(t.type, set()).update(sources(r, below))
    groups: list[set[str]] = []
    for t in edges:
        mine = {t} | {u for u in reach(t, edges) if t in reach(u, edges)}
        if mine not in groups:
            groups.append(mine)
    out: list[set[str]] = []
    while groups:
        done = set().union(*out) if out else set()
        ready = next(g for g in groups if all(s in done or s in g or s not in edges for t in g for s in reach(t, edges)))
        groups.remove(ready)
        out.append(ready)
    return out

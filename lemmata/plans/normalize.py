"""Validation and normal form: disjunction of ordered conjunctions.

Conditions are ordered so that variables are bound before they are used,
accumulators and negations after what they depend on. A negation of more than
one condition stays a unit: it is lowered to an anti-join against its own plan,
correlated by the variables that it shares with the rest, wherever it stands.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from ..functions.expr import Eq, Expr, Var
from .model import Acc, Action, Bool, Cond, Insert, Query, Retract, Rule, RuleError, Test


@dataclass(frozen=True)
class Analysis:
    """A fact condition's constraints by use: ``local`` steps on the fact alone,
    as (variable or None, expression); ``joined`` the same with variables of
    other conditions; ``binds`` what it binds; ``needs`` what it must be given."""

    local: tuple
    joined: tuple
    binds: tuple[str, ...]
    needs: frozenset


def analyse(c: Cond, where: str = "") -> Analysis:
    """Constraints in order: a top-level equality with a variable binds it, or
    checks it if this condition bound it before."""
    local, joined, bound = [], [], []
    pending: list[str] = []  # bound only after the join
    needs: set[str] = set()
    if c.bind:
        bound.append(c.bind)
    for k in c.constraints:
        if isinstance(k, Eq):
            vars_ = [a for a in k.args if isinstance(a, Var)]
            values = [a for a in k.args if not isinstance(a, Var)]
            if vars_ and not values:
                raise RuleError(f"{where}equality of variables only; use a test for that")
            if len(k.args) < 2:
                raise RuleError(f"{where}equality with one operand")
            if vars_:
                first, *rest = values
                outside = first.vars() - set(bound)
                for a in vars_:
                    if a.name in bound and not outside:
                        local.append((None, Eq((a, first))))
                    elif outside:
                        needs |= outside - set(pending)
                        joined.append((a.name, first))
                        if a.name not in bound:
                            pending.append(a.name)
                    else:
                        local.append((a.name, first))
                        bound.append(a.name)
                for r in rest:
                    _place(Eq((first, r)), bound, pending, local, joined, needs)
                continue
        _place(k, bound, pending, local, joined, needs)
    return Analysis(tuple(local), tuple(joined), tuple(bound), frozenset(needs))


def _place(k: Expr, bound, pending, local, joined, needs) -> None:
    outside = k.vars() - set(bound)
    if outside:
        joined.append((None, k))
        needs |= outside - set(pending)
    else:
        local.append((None, k))


def created(a: Analysis) -> set[str]:
    """Variables that the join part may create."""
    return {n for n, _ in a.joined if n}


def exported(c) -> set[str]:
    if isinstance(c, Cond):
        a = analyse(c)
        return set(a.binds) | created(a)
    if isinstance(c, Acc):
        return set(analyse(c.source).binds) | ({c.result} if c.result else set())
    if isinstance(c, Bool) and c.op == "exists":
        return exported(c.parts[0])
    if isinstance(c, Bool) and c.op in ("and", "or"):
        return set().union(*map(exported, c.parts))
    return set()


def mentioned(c) -> set[str]:
    """All variables of a condition."""
    if isinstance(c, Cond):
        out = {c.bind} if c.bind else set()
        return out.union(*(k.vars() for k in c.constraints)) if c.constraints else out
    if isinstance(c, Acc):
        return mentioned(c.source) | ({c.result} if c.result else set())
    if isinstance(c, Test):
        return set().union(*(e.vars() for e in c.exprs))
    return set().union(*map(mentioned, c.parts)) if c.parts else set()


def validate(c, where: str) -> None:
    if isinstance(c, Test):
        if not c.exprs:
            raise RuleError(f"{where}empty test")
    elif isinstance(c, Acc):
        if not isinstance(c.source, Cond):
            raise RuleError(f"{where}an accumulator reduces one fact condition")
        analyse(c.source, where)
    elif isinstance(c, Cond):
        analyse(c, where)
    elif isinstance(c, Bool):
        if c.op == "not" and len(c.parts) != 1:
            raise RuleError(f"{where}not takes one condition")
        if c.op == "exists" and (len(c.parts) != 1 or not isinstance(c.parts[0], Cond)):
            raise RuleError(f"{where}exists takes one fact condition")
        for p in c.parts:
            validate(p, where)
    else:
        raise RuleError(f"{where}not a condition: {c!r}")


def disjuncts(c, nested: bool = False) -> list[tuple]:
    """Conjunctions whose union a condition is."""
    if isinstance(c, Bool):
        if c.op == "or":
            return [d for p in c.parts for d in disjuncts(p, True)]
        if c.op == "and":
            return [sum(d, ()) for d in product(*(disjuncts(p, True) for p in c.parts))]
        if c.op == "not":
            inner = c.parts[0]
            if isinstance(inner, Test):
                return [(Bool("not", (inner,)),)]
            if nested and isinstance(inner, Bool) and inner.op == "not":
                return disjuncts(inner.parts[0], True)
            if isinstance(inner, Bool) and inner.op == "exists":
                return [(Bool("not", inner.parts),)]
    return [(c,)]


def conjunctions(when: tuple) -> list[tuple]:
    """The left-hand side as conjunctions, identical ones once."""
    out, seen = [], set()
    for d in disjuncts(Bool("and", when)) if when else [()]:
        key = tuple(c.key() for c in d)
        if key not in seen:
            seen.add(key)
            out.append(d)
    return out


def ordered(conditions: tuple, given: frozenset = frozenset(), where: str = "") -> list:
    """Conditions so that each finds its variables bound."""
    # what some positive condition binds must be bound before a negation looks at it
    offers = set(given).union(*(exported(c) for c in conditions)) if conditions else set(given)
    bound, left, out = set(given), list(conditions), []

    def wants(c) -> set[str]:
        if isinstance(c, Cond):
            return set(analyse(c, where).needs)
        if isinstance(c, Test):
            return mentioned(c)
        if isinstance(c, Acc):
            a = analyse(c.source, where)
            others = set(given).union(*(exported(o) for o in conditions if o is not c and not isinstance(o, Acc)))
            return set(a.needs) | created(a) & others | set(a.binds) & others
        if c.op == "exists":
            return set(analyse(c.parts[0], where).needs)
        inner = c.parts[0]
        if isinstance(inner, (Cond, Test)):
            return mentioned(inner) - ({inner.bind} if isinstance(inner, Cond) else set())
        return (mentioned(inner) & offers) | (unbound(inner, offers) if not isinstance(inner, Bool) else set())

    while left:
        ready = [c for c in left if wants(c) <= bound]
        if not ready:
            missing = sorted(set().union(*(wants(c) for c in left)) - bound - {e for c in left for e in exported(c)}) or sorted(set().union(*(wants(c) for c in left)) - bound)
            raise RuleError(f"{where}unbound variables: {', '.join('?' + m for m in missing)}")
        c = next((c for c in ready if not isinstance(c, Acc)), ready[0])
        left.remove(c)
        out.append(c)
        bound |= exported(c)
    return out


def unbound(c, offers: set[str]) -> set[str]:
    return {n for n in (analyse(c.source).needs if isinstance(c, Acc) else set()) if n not in offers}


def check(p: Rule | Query) -> None:
    """Raises RuleError for whatever could not be lowered."""
    where = f"{'rule' if isinstance(p, Rule) else 'query'} {p.name}: "
    for i, c in enumerate(p.when):
        validate(c, f"{where}condition {i + 1}: ")
    common = None
    for d in conjunctions(p.when):
        have = set().union(*(exported(c) for c in ordered(d, where=where))) if d else set()
        common = have if common is None else common | have
    if isinstance(p, Query):
        if missing := set(p.params) - common:
            raise RuleError(f"{where}parameters not bound: {', '.join(sorted(missing))}")
        return
    for t in p.then:
        if isinstance(t, Action):
            continue
        if not isinstance(t, (Insert, Retract)):
            raise RuleError(f"{where}not an action: {t!r}")
        used = set().union(*(e.vars() for _, e in t.columns)) if t.columns else set()
        if isinstance(t, Insert):
            if t.each:
                used = (used - {t.each[0]}) | t.each[1].vars()
            if t.when is not None:
                used |= t.when.vars() - ({t.each[0]} if t.each else set())
        elif t.fact:
            used |= {t.fact}
        if missing := used - common:
            raise RuleError(f"{where}unbound variables in its actions: {', '.join(sorted(missing))}")

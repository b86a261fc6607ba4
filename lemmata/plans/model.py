"""Rules and queries as plain data."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from ..functions.accumulators import Accumulator
from ..functions.accumulators import from_data as acc_from_data
from ..functions.expr import Expr, expr, from_data, to_data


class ActionError(RuntimeError):
    """A right-hand side's own error, with the ``rule`` and the ``bindings`` that it met."""

    def __init__(self, rule: str, bindings: dict, cause: BaseException):
        super().__init__(f"rule {rule} failed on {bindings}: {type(cause).__name__}: {cause}")
        self.rule, self.bindings = rule, bindings


class RuleError(ValueError):
    """A production that cannot be compiled; the message names it."""


@dataclass(frozen=True, eq=False)
class Cond:
    """Facts of ``type`` that satisfy every constraint. ``bind`` names the whole
    fact; ``args`` gives names to parts of it (name -> expression)."""

    type: str
    constraints: tuple[Expr, ...] = ()
    bind: str | None = None
    args: tuple[tuple[str, Expr], ...] = ()

    def key(self):
        return ("cond", self.type, tuple(c.key() for c in self.constraints), self.bind, tuple((n, e.key()) for n, e in self.args))


def cond(type: str, *constraints, bind: str | None = None, args: dict | None = None) -> Cond:
    """A condition; empty constraints (None) are ignored."""
    named = tuple((n, expr(e)) for n, e in (args or {}).items())
    return Cond(type, tuple(expr(c) for c in constraints if c is not None), bind and bind.removeprefix("?"), named)


@dataclass(frozen=True, eq=False)
class Acc:
    """``result`` (optional) is the reduction of the facts of ``source``."""

    accumulator: Accumulator
    source: Cond
    result: str | None = None

    def key(self):
        data = tuple(x.key() if isinstance(x, Expr) else x for x in self.accumulator.data)
        return ("acc", self.accumulator.name, data or id(self.accumulator), self.source.key(), self.result)


def acc(result: str | None, accumulator: Accumulator, source: Cond) -> Acc:
    return Acc(accumulator, source, result and result.removeprefix("?"))


@dataclass(frozen=True, eq=False)
class Test:
    """A predicate over variables of other conditions; binds nothing."""

    __test__ = False
    exprs: tuple[Expr, ...]

    def key(self):
        return ("test", tuple(e.key() for e in self.exprs))


def test(*exprs) -> Test:
    return Test(tuple(map(expr, exprs)))


test.__test__ = False


@dataclass(frozen=True, eq=False)
class Bool:
    """``and``, ``or``, ``not`` or ``exists`` of conditions."""

    op: str
    parts: tuple

    def key(self):
        return (self.op, tuple(p.key() for p in self.parts))


def and_(*parts) -> Bool:
    return Bool("and", parts)


def or_(*parts) -> Bool:
    return Bool("or", parts)


def not_(*parts) -> Bool:
    return Bool("not", parts)


def exists(*parts) -> Bool:
    return Bool("exists", parts)


@dataclass(frozen=True, eq=False)
class Insert:
    """Facts to insert for each activation: one, or one for each element of the
    array ``each`` = (variable, expression); only if ``when`` holds. Facts that
    are not ``unconditional`` go when their activation does."""

    type: str
    columns: tuple[tuple[str, Expr], ...]
    when: Expr | None = None
    each: tuple[str, Expr] | None = None
    unconditional: bool = False


def insert(type: str, when=None, each: tuple | None = None, unconditional: bool = False, **columns) -> Insert:
    return Insert(type, tuple((c, expr(e)) for c, e in columns.items()), None if when is None else expr(when), each and (each[0].removeprefix("?"), expr(each[1])), unconditional)


@dataclass(frozen=True, eq=False)
class Retract:
    """Removes one fact equal to the given one for each activation: the fact
    bound to ``fact``, or one of ``type`` with these ``columns``."""

    type: str
    columns: tuple[tuple[str, Expr], ...] = ()
    fact: str | None = None


def retract(type: str, fact: str | None = None, **columns) -> Retract:
    return Retract(type, tuple((c, expr(e)) for c, e in columns.items()), fact and fact.removeprefix("?"))


@dataclass(frozen=True, eq=False)
class Action:
    """A Python function called on the driver with each new activation's
    bindings, for side effects."""

    fn: Callable[[dict], None]


@dataclass(frozen=True, eq=False)
class Rule:
    name: str
    when: tuple
    then: tuple = ()
    salience: int = 0
    no_loop: bool = False
    doc: str | None = None


@dataclass(frozen=True, eq=False)
class Query:
    name: str
    when: tuple
    params: tuple[str, ...] = ()
    doc: str | None = None


def rule(name: str, when: list, then: list | tuple = (), **props) -> Rule:
    return Rule(name, tuple(when), tuple(then) if isinstance(then, (list, tuple)) else (then,), **props)


def query(name: str, when: list, params: list | tuple = (), doc: str | None = None) -> Query:
    return Query(name, tuple(when), tuple(p.removeprefix("?") for p in params), doc)


@dataclass(frozen=True)
class FactType:
    """Schema (DDL or StructType) and ancestors of a type; a condition on an
    ancestor also sees this type's facts. ``columns`` renames columns to the
    ancestor's where they differ: {ancestor: {its column: own column}}."""

    name: str
    schema: object
    parents: tuple[str, ...] = ()
    columns: dict = field(default_factory=dict, compare=False)


# productions as JSON values, for rule files and stored sessions


def condition_to_data(c):
    if isinstance(c, Cond):
        return {"type": c.type, "constraints": [to_data(e) for e in c.constraints], "bind": c.bind, "args": {n: to_data(e) for n, e in c.args}}
    if isinstance(c, Acc):
        if not c.accumulator.data:
            raise ValueError(f"accumulator {c.accumulator.name} holds functions and cannot be stored")
        return {"acc": [to_data(x) if isinstance(x, Expr) else x for x in c.accumulator.data], "from": condition_to_data(c.source), "result": c.result}
    if isinstance(c, Test):
        return {"test": [to_data(e) for e in c.exprs]}
    return {c.op: [condition_to_data(p) for p in c.parts]}


def condition_from_data(d):
    if "type" in d:
        return cond(d["type"], *map(from_data, d.get("constraints", ())), bind=d.get("bind"), args={n: from_data(e) for n, e in (d.get("args") or {}).items()})
    if "acc" in d:
        return acc(d.get("result"), acc_from_data(d["acc"]), condition_from_data(d["from"]))
    if "test" in d:
        return test(*map(from_data, d["test"]))
    (op, parts), = d.items()
    return Bool(op, tuple(map(condition_from_data, parts)))


def to_dict(p: Rule | Query) -> dict:
    if isinstance(p, Query):
        return {"query": p.name, "when": [condition_to_data(c) for c in p.when], "params": list(p.params), "doc": p.doc}
    then = []
    for t in p.then:
        if isinstance(t, Action):
            raise ValueError(f"rule {p.name} holds a Python action and cannot be stored")
        cols = {c: to_data(e) for c, e in t.columns}
        if isinstance(t, Insert):
            then.append({"insert": t.type, "columns": cols, "when": None if t.when is None else to_data(t.when), "each": t.each and [t.each[0], to_data(t.each[1])], "unconditional": t.unconditional})
        else:
            then.append({"retract": t.type, "columns": cols, "fact": t.fact})
    return {"rule": p.name, "when": [condition_to_data(c) for c in p.when], "then": then, "salience": p.salience, "no_loop": p.no_loop, "doc": p.doc}


def from_dict(d: dict) -> Rule | Query:
    when = [condition_from_data(c) for c in d["when"]]
    if "query" in d:
        return query(d["query"], when, d.get("params", ()), d.get("doc"))
    then = []
    for t in d.get("then", ()):
        cols = tuple((c, from_data(e)) for c, e in t.get("columns", {}).items())
        if "insert" in t:
            then.append(Insert(t["insert"], cols, None if t.get("when") is None else from_data(t["when"]), t.get("each") and (t["each"][0], from_data(t["each"][1])), t.get("unconditional", False)))
        else:
            then.append(Retract(t["retract"], cols, t.get("fact")))
    return rule(d["rule"], when, then, salience=d.get("salience", 0), no_loop=d.get("no_loop", False), doc=d.get("doc"))



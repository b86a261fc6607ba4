"""Expressions over fact fields and rule variables, lowered to Columns.

``f("price")`` is a field of the condition's fact, ``v("c")`` a rule variable,
``this`` the whole fact; Python operators combine them, and ``call`` applies any
function of Columns. ``eq`` is an equality of two or more operands, which binds
the variables among them when it is a constraint by itself.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scope:
    """What names stand for while an expression is lowered: Columns, or SQL text."""

    field: Callable[[str], Column | str]
    var: Callable[[str], Column | str]
    this: Callable[[], Column] | None = None
    strict: str | None = None  # what to say of null in a comparison, if it is an error


def as_column(x: Column | str) -> Column:
    return F.expr(x) if isinstance(x, str) else x


def every(parts: list) -> Column | str | None:
    """The conjunction of Columns and SQL texts; None of nothing."""
    if all(isinstance(x, str) for x in parts):
        return " AND ".join(parts) or None
    out = as_column(parts[0])
    for x in parts[1:]:
        out = out & as_column(x)
    return out


class Expr:
    """Base of all expressions; equality of nodes is ``same``, as ``==`` builds
    an expression."""

    def key(self) -> tuple:
        raise NotImplementedError

    def parts(self) -> tuple[Expr, ...]:
        return ()

    def column(self, scope: Scope) -> Column:
        raise NotImplementedError

    def text(self, scope: Scope) -> str | None:
        """The same as SQL, where it is made of names, plain values and
        operators: a text is one call into the JVM, a Column several for each
        of its parts."""
        return None

    def lowered(self, scope: Scope) -> Column | str:
        out = self.text(scope)
        return self.column(scope) if out is None else out

    def vars(self) -> frozenset[str]:
        return frozenset().union(*(p.vars() for p in self.parts())) if self.parts() else frozenset()

    def fields(self) -> frozenset[str]:
        return frozenset().union(*(p.fields() for p in self.parts())) if self.parts() else frozenset()

    def uses_this(self) -> bool:
        return any(p.uses_this() for p in self.parts())

    def same(self, other: Expr) -> bool:
        return self.key() == other.key()

    __hash__ = None

    def __add__(self, o):
        return op("+", self, o)

    def __radd__(self, o):
        return op("+", o, self)

    def __sub__(self, o):
        return op("-", self, o)

    def __rsub__(self, o):
        return op("-", o, self)

    def __mul__(self, o):
        return op("*", self, o)

    def __rmul__(self, o):
        return op("*", o, self)

    def __truediv__(self, o):
        return op("/", self, o)

    def __mod__(self, o):
        return op("%", self, o)

    def __lt__(self, o):
        return op("<", self, o)

    def __le__(self, o):
        return op("<=", self, o)

    def __gt__(self, o):
        return op(">", self, o)

    def __ge__(self, o):
        return op(">=", self, o)

    def __eq__(self, o):
        return eq(self, o)

    def __ne__(self, o):
        return op("!=", self, o)

    def __and__(self, o):
        return op("&", self, o)

    def __or__(self, o):
        return op("|", self, o)

    def __invert__(self):
        return op("~", self)


def expr(x) -> Expr:
    return x if isinstance(x, Expr) else Lit(x)


class Lit(Expr):
    def __init__(self, value):
        self.value = value

    def key(self):
        return ("lit", type(self.value).__name__, repr(self.value))

    def column(self, scope):
        return F.lit(self.value)

    def text(self, scope):
        x = self.value
        if x is None or isinstance(x, bool):
            return str("NULL" if x is None else x)
        if isinstance(x, int):
            return str(x) if -(2**31) < x < 2**31 else f"{x}L" if -(2**63) < x < 2**63 else None
        if isinstance(x, str) and x.isprintable() and not set(x) & set("'\\"):
            return f"'{x}'"
        return None


class Field(Expr):
    def __init__(self, name: str):
        self.name = name

    def key(self):
        return ("field", self.name)

    def fields(self):
        return frozenset([self.name])

    def column(self, scope):
        return as_column(scope.field(self.name))

    def text(self, scope):
        x = scope.field(self.name)
        return x if isinstance(x, str) else None


class Var(Expr):
    def __init__(self, name: str):
        self.name = name.removeprefix("?")

    def key(self):
        return ("var", self.name)

    def vars(self):
        return frozenset([self.name])

    def column(self, scope):
        return as_column(scope.var(self.name))

    def text(self, scope):
        x = scope.var(self.name)
        return x if isinstance(x, str) else None


class This(Expr):
    def key(self):
        return ("this",)

    def uses_this(self):
        return True

    def column(self, scope):
        return scope.this()


_OPS: dict[str, Callable[..., Column]] = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: a / b,
    "%": lambda a, b: a % b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "!=": lambda a, b: ~a.eqNullSafe(b),
    "&": lambda a, b: a & b,
    "|": lambda a, b: a | b,
    "~": lambda a: ~F.coalesce(a, F.lit(False)),
}


_TEXTS = {
    **{k: f"({{0}} {k} {{1}})" for k in ("+", "-", "*", "/", "%", "<", "<=", ">", ">=")},
    "!=": "(NOT ({0} <=> {1}))",
    "&": "({0} AND {1})",
    "|": "({0} OR {1})",
    "~": "(NOT coalesce({0}, false))",
}


class Op(Expr):
    def __init__(self, name: str, args: tuple[Expr, ...]):
        self.name, self.args = name, args

    def key(self):
        return ("op", self.name, *(a.key() for a in self.args))

    def parts(self):
        return self.args

    def _seen(self):
        """All operands, those of operands included, each once."""
        out, todo = {}, list(self.args)
        while todo:
            e = todo.pop(0)
            out.setdefault(e.key(), e)
            todo += e.parts()
        return list(out.values())

    def column(self, scope):
        args = [a.column(scope) for a in self.args]
        out = _OPS[self.name](*args)
        if scope.strict and self.name in ("<", "<=", ">", ">="):
            seen = [x for x in self._seen() if isinstance(x, (Field, Var))]
            with_values = [F.concat(F.lit(f"; {'?' if isinstance(x, Var) else ''}{x.name} = "), F.coalesce(x.column(scope).cast("string"), F.lit("null"))) for x in seen]
            told = F.concat(F.lit(f"null in a comparison: {scope.strict}"), *with_values)
            return F.when(args[0].isNull() | args[1].isNull(), F.raise_error(told)).otherwise(out)
        return out

    def text(self, scope):
        args = [a.text(scope) for a in self.args]
        if None in args or (scope.strict and self.name in ("<", "<=", ">", ">=")):
            return None
        return _TEXTS[self.name].format(*args)


def op(name: str, *args) -> Op:
    return Op(name, tuple(map(expr, args)))


class Eq(Expr):
    """Equality of all operands; null equals null."""

    def __init__(self, args: tuple[Expr, ...]):
        self.args = args

    def key(self):
        return ("eq", *(a.key() for a in self.args))

    def parts(self):
        return self.args

    def column(self, scope):
        first, *rest = (a.column(scope) for a in self.args)
        out = F.lit(True)
        for r in rest:
            out = out & first.eqNullSafe(r) if r is not rest[0] else first.eqNullSafe(r)
        return out

    def text(self, scope):
        args = [a.text(scope) for a in self.args]
        if None in args or len(args) < 2:
            return None
        return "(" + " AND ".join(f"({args[0]} <=> {r})" for r in args[1:]) + ")"


class Call(Expr):
    """A function of Columns. ``fn`` is a callable or an import path
    ``module:name``; only the latter can be stored as data."""

    def __init__(self, fn, args: tuple[Expr, ...]):
        self.fn, self.args = fn, args

    def key(self):
        name = self.fn if isinstance(self.fn, str) else f"{self.fn.__module__}:{self.fn.__qualname__}:{id(self.fn)}"
        return ("call", name, *(a.key() for a in self.args))

    def parts(self):
        return self.args

    def column(self, scope):
        fn = self.fn
        if isinstance(fn, str):
            module, _, name = fn.partition(":")
            fn = getattr(importlib.import_module(module), name)
        return fn(*(a.column(scope) for a in self.args))


this = This()


def f(name: str) -> Field:
    return Field(name)


def v(name: str) -> Var:
    return Var(name)


def lit(value) -> Lit:
    return Lit(value)


def eq(*args) -> Eq:
    return Eq(tuple(map(expr, args)))


def call(fn, *args) -> Call:
    return Call(fn, tuple(map(expr, args)))


def to_data(e: Expr):
    """A JSON value for an expression."""
    if isinstance(e, Lit):
        return {"lit": e.value}
    if isinstance(e, Field):
        return {"field": e.name}
    if isinstance(e, Var):
        return {"var": e.name}
    if isinstance(e, This):
        return {"this": True}
    if isinstance(e, Eq):
        return {"eq": [to_data(a) for a in e.args]}
    if isinstance(e, Op):
        return {"op": e.name, "args": [to_data(a) for a in e.args]}
    if isinstance(e, Call):
        fn = e.fn if isinstance(e.fn, str) else f"{e.fn.__module__}:{e.fn.__qualname__}"
        if "<" in fn:
            raise ValueError(f"{fn} has no import path and cannot be stored")
        return {"call": fn, "args": [to_data(a) for a in e.args]}
    raise TypeError(type(e))


def from_data(d) -> Expr:
    if not isinstance(d, dict):
        return Lit(d)
    if "lit" in d:
        return Lit(d["lit"])
    if "field" in d:
        return Field(d["field"])
    if "var" in d:
        return Var(d["var"])
    if "this" in d:
        return this
    if "eq" in d:
        return eq(*map(from_data, d["eq"]))
    if "op" in d:
        return op(d["op"], *map(from_data, d["args"]))
    return call(d["call"], *map(from_data, d["args"]))

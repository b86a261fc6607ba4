"""A validated set of fact types, rules and queries."""

from __future__ import annotations

import functools
import importlib
import json
from collections.abc import Callable, Iterable

from pyspark.sql import types as T

from ..plans import model
from ..plans.model import FactType, Query, Rule, RuleError
from ..plans.normalize import check
from ..plans.stratify import mode, read_types


def schema_of(t: FactType) -> T.StructType:
    return t.schema if isinstance(t.schema, T.StructType) else _parsed(t.schema)


@functools.lru_cache(maxsize=10_000)
def _parsed(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


class Rulebase:
    """Types and productions. Identical productions count once; two different
    ones of a name are an error. Rules fire in the order given, higher salience
    first; ``group_of`` and ``group_key`` change the grouping and its order.
    ``identity`` gives every fact an id, the field ``__fid``, by which equal facts
    can be told apart, and has the agenda loop keep it."""

    def __init__(self, types: Iterable[FactType], productions: Iterable, group_of: Callable[[Rule], object] | None = None, group_key: Callable[[object], object] | None = None, identity: bool = False):
        self.types = {t.name: t for t in types}
        self.rules: list[Rule] = []
        self.queries: dict[str, Query] = {}
        seen: dict[str, object] = {}
        for p in productions:
            if p.name in seen:
                if seen[p.name] is p or _same(seen[p.name], p):
                    continue
                raise RuleError(f"two productions are named {p.name}")
            seen[p.name] = p
            check(p)
            for c in p.when:
                for t, _ in read_types(c):
                    self._known(t, p.name)
            if isinstance(p, Query):
                self.queries[p.name] = p
            else:
                for t in p.then:
                    if not isinstance(t, model.Action):
                        self._known(t.type, p.name)
                self.rules.append(p)
        self.group_of = group_of or (lambda r: r.salience)
        self.group_key = group_key or (lambda g: -g)
        self.identity = identity
        self.mode = "agenda" if identity else mode(self.rules, self.types)

    def plus(self, other: Rulebase) -> Rulebase:
        """Both rulebases' types and productions, these first."""
        types = self.types | {n: t for n, t in other.types.items() if n not in self.types}
        every = (*self.rules, *self.queries.values(), *other.rules, *other.queries.values())
        return Rulebase(types.values(), every, self.group_of, self.group_key, self.identity or other.identity)

    def _known(self, name: str, where: str) -> None:
        if name not in self.types and not any(name in t.parents for t in self.types.values()):
            raise RuleError(f"{where}: unknown fact type {name}")

    def groups(self) -> list[list[Rule]]:
        """Rules by activation group, first group first."""
        by: dict = {}
        for r in self.rules:
            by.setdefault(self.group_of(r), []).append(r)
        return [by[g] for g in sorted(by, key=self.group_key)]

    def columns(self, name: str) -> list[tuple[str, T.DataType]]:
        return [(c.name, c.dataType) for c in schema_of(self.types[name]).fields]

    def to_json(self) -> str:
        types = [{"name": t.name, "schema": schema_of(t).jsonValue(), "parents": list(t.parents), "columns": t.columns} for t in self.types.values()]
        return json.dumps({"types": types, "productions": [model.to_dict(p) for p in (*self.rules, *self.queries.values())]}, default=str)

    @classmethod
    def from_json(cls, text: str, **options) -> Rulebase:
        d = json.loads(text)
        types = [FactType(t["name"], T.StructType.fromJson(t["schema"]), tuple(t["parents"]), t.get("columns") or {}) for t in d["types"]]
        return cls(types, map(model.from_dict, d["productions"]), **options)


def _same(a, b) -> bool:
    try:
        return model.to_dict(a) == model.to_dict(b)
    except ValueError:
        return False


def productions(*sources) -> list:
    """Productions from modules, import paths, lists, dicts or single ones."""
    out = []
    for s in sources:
        if isinstance(s, str):
            s = importlib.import_module(s)
        if isinstance(s, (Rule, Query)):
            out.append(s)
        elif isinstance(s, dict):
            out.append(model.from_dict(s))
        elif isinstance(s, (list, tuple)):
            out += productions(*s)
        else:
            out += [x for x in vars(s).values() if isinstance(x, (Rule, Query))]
    return out

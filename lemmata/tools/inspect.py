"""Explanations of a session's matches, and its fact graph, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.agenda import TID, Agenda, State, token_id
from ..operators.session import Session
from ..plans.lower import FID, Lowering
from ..plans.model import Rule, RuleError


def _agenda(session: Session) -> Agenda:
    return Agenda(session.rulebase, session.spark, session.base, session.state or State(), session.max_cycles, ())


def _with_ids(session: Session) -> Lowering:
    """Lowering with lineage. Where facts have no ids of their own, a hash of
    their values stands for them."""
    if session.mode == "agenda":
        return Lowering(session.spark, lambda t, i: _agenda(session).facts(t), True)
    facts = session._derived()

    def identified(type: str, i: int) -> DataFrame:
        df = facts(type)
        return df.withColumn(FID, F.xxhash64(F.lit(type), *(F.col(f"`{c}`") for c in df.columns)))

    return Lowering(session.spark, identified, True)


def rule_matches(session: Session, name: str) -> DataFrame:
    """A rule's or query's current matches: bindings, the ids of matched facts
    (``matched``) and those that accumulators reduced (``accumulated``)."""
    found = [p for p in (*session.rulebase.rules, *session.rulebase.queries.values()) if p.name == name]
    if not found:
        raise RuleError(f"unknown production {name}")
    out = None
    for tokens in _with_ids(session).tokens(found[0].when):
        ids = [F.col(c) for c in sorted(tokens.columns) if c.startswith("m_")]
        used = [F.col(c) for c in sorted(tokens.columns) if c.startswith("a_")]
        names = [c for c in tokens.columns if c.startswith("b_")]
        part = tokens.select(
            *(F.col(f"`{c}`").alias(c[2:]) for c in names),
            (F.array(*ids) if ids else F.array().cast("array<long>")).alias("matched"),
            (F.flatten(F.array(*used)) if used else F.array().cast("array<long>")).alias("accumulated"),
        )
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def condition_matches(session: Session, type: str, *constraints) -> DataFrame:
    """Facts of a type that pass constraints on the fact alone."""
    from ..plans.model import cond

    _, cand = _with_ids(session).candidates(cond(type, *constraints), 0, True)
    return cand.select("__this.*")


def insertions(session: Session) -> DataFrame:
    """(rule, activation, fact_type, fact) of every fact that a rule holds."""
    edges = fact_graph(session)
    return edges.where("kind = 'insert'").select(F.col("rule"), F.col("source").alias("activation"), "fact_type", F.col("target").alias("fact"))


def fact_graph(session: Session) -> DataFrame:
    """Edges (kind, rule, source, target, fact_type): ``match`` from a fact to an
    activation, ``accumulate`` from a reduced fact, ``insert`` from an activation
    to the fact that it logically inserted."""
    parts = []
    for r in session.rulebase.rules:
        if session.mode == "agenda":
            agenda = _agenda(session)
            tokens = agenda.current(r)
        else:
            tokens = None
            lower = _with_ids(session)
            for k, t in enumerate(lower.tokens(r.when)):
                cols = [F.col(f"`{c}`") for c in sorted(t.columns) if not c.startswith("a_")]
                t = t.withColumn(TID, token_id(F.lit(r.name), F.lit(k), *cols))
                tokens = t if tokens is None else tokens.unionByName(t, allowMissingColumns=True)
        parts += _edges(session, r, tokens)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _edges(session: Session, r: Rule, tokens: DataFrame) -> list[DataFrame]:
    out = []
    activation = F.xxhash64(F.col(TID))
    for prefix, kind in (("m_", "match"), ("a_", "accumulate")):
        for c in (c for c in tokens.columns if c.startswith(prefix)):
            fact = F.explode(c) if prefix == "a_" else F.col(c)
            out.append(tokens.select(F.lit(kind).alias("kind"), F.lit(r.name).alias("rule"), fact.alias("source"), activation.alias("target"), F.lit(None).cast("string").alias("fact_type")).where("source is not null"))
    from ..plans.lower import inserted

    for k, t in enumerate(r.then):
        if getattr(t, "unconditional", True):
            continue
        cols = session.rulebase.columns(t.type)
        rows = inserted(tokens, t, [c for c, _ in cols], dict(cols), [TID, "__at"])
        if session.mode == "agenda":
            fact = F.xxhash64(F.lit(r.name), TID, F.lit(k), "__at")
        else:
            fact = F.xxhash64(F.lit(t.type), *(F.col(f"`{c}`") for c, _ in cols))
        out.append(rows.select(F.lit("insert").alias("kind"), F.lit(r.name).alias("rule"), activation.alias("source"), fact.alias("target"), F.lit(t.type).alias("fact_type")))
    return out


def explanations(session: Session) -> DataFrame:
    """(fact_type, fact, rule, activation, matched, accumulated) of every
    derived fact: why it is there, once for each activation that holds it."""
    edges = fact_graph(session)
    held = edges.where("kind = 'insert'").select("fact_type", F.col("target").alias("fact"), "rule", F.col("source").alias("activation"))
    behind = edges.where("kind <> 'insert'").groupBy("rule", F.col("target").alias("activation")).agg(
        *(F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("source")))).alias(c) for k, c in (("match", "matched"), ("accumulate", "accumulated")))
    )
    none = F.array().cast("array<long>")
    return held.join(behind, ["rule", "activation"], "left").select("fact_type", "fact", "rule", "activation", F.coalesce("matched", none).alias("matched"), F.coalesce("accumulated", none).alias("accumulated"))


def activations_fired(session: Session, name: str) -> DataFrame:
    """(step, activation, bindings, matched) of every activation of a rule that
    ever fired, those whose support has gone included; ``bindings`` is JSON.
    Needs ``with_full_logging``."""
    if not session.full:
        raise RuleError("the session does not log activations; see with_full_logging")
    if name not in {r.name for r in session.rulebase.rules}:
        raise RuleError(f"unknown rule {name}")
    found = session.state.history if session.state else {}
    if name in found:
        return found[name]
    return session.spark.createDataFrame([], "step int, activation string, bindings string, matched array<long>")


def explain(session: Session, limit: int = 20) -> str:
    """A text of the rules' matches, ``limit`` of each."""
    lines = []
    for r in session.rulebase.rules:
        lines.append(f"rule {r.name}" + (f": {r.doc}" if r.doc else ""))
        rows = rule_matches(session, r.name).limit(limit).collect()
        lines += [f"  {x.asDict(recursive=True)}" for x in rows] or ["  no match"]
    return "\n".join(lines)


def trace(session: Session) -> list[tuple[str, str | None, str]]:
    """Events of all firings so far: (event, rule, what)."""
    return list(session.state.log) if session.state else []


def ranked_productions(session: Session) -> list[tuple[str, int]]:
    """Rules by the activations that they fired and withdrew, most first. A
    session that runs as one plan has no such history; its rules, and queries,
    are ranked by their matches now."""
    n: dict[str, int] = {}
    if session.mode == "agenda":
        for event, rule, what in trace(session):
            if event in ("fire-activations", "retract-activations"):
                n[rule] = n.get(rule, 0) + int(what)
    else:
        for p in (*session.rulebase.rules, *session.rulebase.queries.values()):
            n[p.name] = rule_matches(session, p.name).count()
    return sorted(n.items(), key=lambda x: (-x[1], x[0]))

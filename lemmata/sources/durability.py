"""Sessions stored as Parquet tables and a manifest.

Rules are stored as data, so functions in them need import paths. A restored
session goes on where the stored one stood: fact ids, derived facts and fired
activations are kept.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from ..operators.agenda import State
from ..operators.rulebase import Rulebase
from ..operators.session import Session


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"].strip()


def save_rulebase(spark: SparkSession, rulebase: Rulebase, path: str) -> None:
    _write_text(spark, f"{path}/rulebase", rulebase.to_json())


def load_rulebase(spark: SparkSession, path: str, **options) -> Rulebase:
    return Rulebase.from_json(_read_text(spark, f"{path}/rulebase"), **options)


def save(session: Session, path: str, with_rulebase: bool = True) -> None:
    """Writes a fired session; queued operations must have been applied."""
    if session.pending:
        raise ValueError("fire the session before it is stored")
    spark = session.spark
    if with_rulebase:
        save_rulebase(spark, session.rulebase, path)
    state = session.state or State()
    parts = {"base": session.base, "derived": state.derived, "fired": state.fired, "history": state.history}
    names = {kind: {n: f"{kind}-{i}" for i, n in enumerate(tables)} for kind, tables in parts.items()}
    for kind, tables in parts.items():
        for n, df in tables.items():
            df.write.mode("overwrite").parquet(f"{path}/{names[kind][n]}")
    manifest = {"tables": names, "schemas": {k: {n: df.schema.jsonValue() for n, df in t.items()} for k, t in parts.items()}, "serial": session.serial, "max_cycles": session.max_cycles, "log": state.log, "full": session.full, "agenda": session.state is not None}
    _write_text(spark, f"{path}/manifest", json.dumps(manifest))


def load(spark: SparkSession, path: str, rulebase: Rulebase | None = None, **options) -> Session:
    """The stored session, on a given rulebase or on the stored one."""
    from pyspark.sql.types import StructType

    rulebase = rulebase or load_rulebase(spark, path, **options)
    m = json.loads(_read_text(spark, f"{path}/manifest"))
    parts = {k: {n: spark.read.schema(StructType.fromJson(m["schemas"][k][n])).parquet(f"{path}/{p}") for n, p in t.items()} for k, t in m["tables"].items()}
    state = State(parts["derived"], parts["fired"], tuple(map(tuple, m["log"])), parts["history"]) if m["agenda"] else None
    return Session(rulebase, spark, parts["base"], (), state, m["serial"], m["max_cycles"], full=m["full"])

"""Tables and files as facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.rulebase import Rulebase
from ..operators.session import Session
from ..plans.model import FactType


def read(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    """Any format that Spark reads."""
    return spark.read.format(format).options(**options).load(path)


def fact_type(name: str, df: DataFrame, parents: tuple = (), columns: dict | None = None) -> FactType:
    """A fact type with the schema of a table."""
    return FactType(name, df.schema, parents, columns or {})


def session(spark: SparkSession, tables: dict[str, DataFrame], productions: list, derived: list[FactType] = (), parents: dict | None = None, **options) -> Session:
    """A session whose facts are ``tables``; ``derived`` are the types that only
    rules insert, ``parents`` gives {type: (parents, column names)}."""
    types = [fact_type(n, df, *(parents or {}).get(n, ())) for n, df in tables.items()]
    out = Session(Rulebase([*types, *derived], productions), spark, **options)
    for n, df in tables.items():
        out = out.insert(n, df)
    return out

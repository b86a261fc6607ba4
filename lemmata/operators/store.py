"""Tables between the steps of a loop, and multisets of facts."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.lower import FID


@cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="lemmata-")


def folder(spark: SparkSession) -> str:
    """A folder of this application in ``spark.checkpoint.dir`` of the session,
    which driver and executors share. Where that is unset, a temporary folder of
    this machine will do in local mode, and only there."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def cleared(spark: SparkSession) -> None:
    """Deletes all tables that this application stored. DataFrames and sessions
    that rest on them can't be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """The rows written and read again: their lineage ends here, and they
    survive the loss of executors."""
    path = f"{folder(df.sparkSession)}/facts-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def values(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("__")]


def same(a: str, b: str, columns: list[str]) -> Column:
    out = None
    for c in columns:
        k = F.col(f"{a}.`{c}`").eqNullSafe(F.col(f"{b}.`{c}`"))
        out = k if out is None else out & k
    return F.lit(True) if out is None else out


def without(facts: DataFrame, gone: DataFrame) -> DataFrame:
    """``facts`` less one equal instance for each row of ``gone``; rows that
    equal none are ignored.

    Rows with ids are numbered within equal values, the lowest ids going first.
    The count of instances to remove is one row for each value."""
    cols = values(facts)
    if FID not in facts.columns:
        return facts.exceptAll(gone.select(*(F.col(f"`{c}`") for c in cols)))
    n = gone.groupBy(*(F.col(f"`{c}`") for c in cols)).agg(F.count("*").alias("__n"))
    touched = facts.alias("f").join(n.alias("g"), same("f", "g", cols), "left").select("f.*", "g.__n")
    rank = F.row_number().over(Window.partitionBy(*(F.col(f"`{c}`") for c in cols)).orderBy(FID))
    kept = touched.where("__n is not null").withColumn("__k", rank).where(F.col("__k") > F.col("__n")).drop("__k")
    return touched.where("__n is null").unionByName(kept).drop("__n")


def netted(added: DataFrame, removed: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Insertions and retractions of equal facts cancelled against each other:
    what is left to insert and what is left to retract."""
    cols = values(facts)
    names = [F.col(f"`{c}`") for c in cols]
    signed = added.select(*names, F.lit(1).alias("__d")).unionByName(removed.select(*names, F.lit(-1).alias("__d")))
    net = signed.groupBy(*names).agg(F.sum("__d").alias("__d"))

    def times(n: Column) -> DataFrame:
        return net.where(n > 0).select(*names, F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("__i")).drop("__i")

    return times(F.col("__d")), times(-F.col("__d"))

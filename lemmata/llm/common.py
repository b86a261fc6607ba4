"""What the corpus operators share: scratch tables, hashing and Arrow plumbing."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..operators.store import folder

#: The white space that separates words everywhere in this subpackage.
SPACES = " \t\n\x0b\x0c\r"


def written(df: DataFrame, what: str, batch: int = 1000) -> DataFrame:
    """``df`` as a Parquet table in this application's folder in
    ``spark.checkpoint.dir``, read again. This cuts
    the lineage, and the rows survive the loss of any executor. Python
    functions in its plan get ``batch`` rows at a time, which bounds what they
    and the JVM hold of long texts."""
    spark = df.sparkSession
    path, key = f"{folder(spark)}/{what}-{uuid.uuid4().hex}", "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(batch))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def hash_sample(df: DataFrame, column: str, rows: int) -> DataFrame:
    """At most ``rows`` rows of smallest hash of ``column``. Of large tables all
    but about three times as many are filtered out first, so that no partition
    sends its own ``rows`` best on to the sort."""
    bits = 1 << 40
    place = F.pmod(F.xxhash64(column), F.lit(bits))
    n = df.count()
    if n > 4 * rows:
        df = df.where(place < F.lit(-(-bits * 3 * rows // n)))
    return df.orderBy(place, column).limit(rows)


def fitting(df: DataFrame, column: str, amount: Column, most: int) -> DataFrame:
    """Whole rows of the small table ``df``, in order of the hash of
    ``column``, as long as their amounts add up to ``most`` at most. Rows of
    one value go together; those that exceed ``most`` alone are passed over."""
    sizes = df.groupBy(F.col(column).alias("__id")).agg(F.sum(amount).alias("__amount")).where(F.col("__amount") <= most)
    upto = F.sum("__amount").over(Window.orderBy(F.pmod(F.xxhash64("__id"), F.lit(1 << 40)), "__id"))
    kept = sizes.select("__id", upto.alias("__upto")).where(F.col("__upto") <= most)
    return df.join(F.broadcast(kept), F.col(column) == F.col("__id"), "left_semi")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row."""
    return F.transform(F.array(value), body)[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any
    more, which it does once the driver has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def mapped(df: DataFrame, f, schema: StructType) -> DataFrame:
    """``df.mapInArrow(f, schema)`` for columns of any name: ``f`` sees and
    gives columns by their places."""
    plain = StructType([StructField(f"c{i}", x.dataType) for i, x in enumerate(schema.fields)])
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(f, plain).toDF(*schema.names)


def trimming(f):
    """The function of Arrow batches ``f``, which gives the memory that it has
    freed back to the system at its end; a Python worker serves many tasks and
    would else keep it while the JVM beside it needs it."""

    @functools.wraps(f)
    def run(batches):
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return run

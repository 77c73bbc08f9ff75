"""Session helpers: where intermediate tables live and how lineage is cut."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_ROOTS: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``; where that is unset, under the warehouse, which executors share too.

    The folder goes when the application ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
        _ROOTS[app] = f"{shared.rstrip('/')}/cohortspan-{app}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_ROOTS[app])
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return _ROOTS[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The result has no lineage (a lost executor costs a re-read, not a recompute), is columnar, so
    later stages prune to the columns they use, and carries real file sizes, so the optimizer's
    broadcast decisions rest on measured bytes.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at_once(spark: SparkSession, jobs: list[Callable]) -> list:
    """The results of driver steps that do not need each other; their Spark jobs run side by side."""
    if len(jobs) < 2:
        return [job() for job in jobs]
    with ThreadPoolExecutor(len(jobs)) as threads:
        running = [threads.submit(inheritable_thread_target(spark)(job)) for job in jobs]
        return [r.result() for r in running]


SMALL_ROWS = 50_000


def from_rows(spark: SparkSession, rows: list[tuple], schema: str | StructType) -> DataFrame:
    """A table of driver-held parameters (rules, terms, coefficients); small by check, so broadcast."""
    if len(rows) > SMALL_ROWS:
        raise ValueError("parameter tables are small; write larger ones to storage")
    return F.broadcast(spark.createDataFrame(rows, schema))


def small_or_stored(df: DataFrame, name: str = "small") -> DataFrame:
    """Evaluate once: a table that proves small becomes a broadcast parameter table, others are written."""
    rows = df.limit(SMALL_ROWS + 1).collect()
    if len(rows) <= SMALL_ROWS:
        return from_rows(df.sparkSession, rows, df.schema)
    return materialize(df, name)

"""Tables between the steps of a plan, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
#: Whether Spark deletes a query's shuffle files once it is done.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where it is unset, a temporary one if Spark runs in this process' machine
    alone; on a cluster that is an error, as executors would not share it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="svloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends here, and lost executors cost nothing before it.

    What was shuffled for it is deleted at once, as nothing reads that again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], name: str = "step") -> DataFrame:
    """What ``make`` plans, stored; the tables that it stored on its way are deleted, so nothing else may read them."""
    first = len(_written)
    out = stored(make(), name)
    kept = _written.pop()
    release(out.sparkSession, first)
    _written.append(kept)
    return out


def release(spark: SparkSession, first: int = 0) -> int:
    """Deletes what ``stored`` wrote so far in this process (from the ``first`` table on), and returns how many tables that were.

    Call it once results that read those tables are written or collected.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while len(_written) > first:
        at = jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += at.getFileSystem(conf).delete(at, True)
    return n

"""What the text operators share: storage between steps, splits, Arrow maps."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reachable
from ..storage import stored

#: Rows in one Arrow batch handed to Python; with texts of a few KB a batch stays at some MB.
BATCH_ROWS = 1000
#: Bytes in one Arrow batch, whichever limit comes first.
BATCH_BYTES = 8 << 20


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for two Python workers beside a small heap, and the package importable there."""
    reachable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends here and lost executors cost nothing before it."""
    return stored(df, name)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def own_columns(df: DataFrame) -> list[Column]:
    """All columns of ``df`` by their names, which may hold dots."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def crc_mod(col: str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; -1 for a null id, which so belongs to every training side."""
    return F.coalesce(F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(by)), F.lit(-1))


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | dict | None], schema: str) -> DataFrame:
    """``mapInArrow`` for functions of one batch; a dict becomes a batch in the order of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None:
                    yield pa.RecordBatch.from_pydict(out) if isinstance(out, dict) else out

    return df.mapInArrow(run, schema)


def utf8(array: pa.Array) -> list[bytes]:
    """The strings of an Arrow array as bytes, null as empty."""
    return [x or b"" for x in array.cast(pa.binary()).to_pylist()]


def stable_seed(*parts: object) -> int:
    return zlib.crc32(repr(parts).encode())


def passed_through(df: DataFrame, text_col: str, decide: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """The rows of ``df`` for which ``decide`` (texts -> booleans) holds, unchanged in columns and types.

    Decisions are made row by row where the row is, so null or repeated ids and
    clashing column names can't mix rows up, and nothing is shuffled.
    """
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(decide(utf8(batch.column(at))), pa.bool_()))

    # plain names on the way, as column names may hold dots
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


#: Rows from which a join's key may count as hot, and the part of all rows beyond which it does.
HOT_ROWS, HOT_PART = 1000, 1000


def joined_by_weight(left: DataFrame, right: DataFrame, key: str, weight: str) -> DataFrame:
    """``left`` joined with ``right``, whose keys are unique and whose ``weight`` says how many rows of ``left`` have each.

    Keys with a thousandth of the rows, which are a thousand at most, are
    broadcast; so the shuffled join has no hot key.  ``left`` is read three
    times and best a stored table; ``weight`` is dropped.
    """
    cut = max(HOT_ROWS, left.count() // HOT_PART)
    hot, rest = F.broadcast(right.where(F.col(weight) >= cut).drop(weight)), right.where(F.col(weight) < cut).drop(weight)
    few = left.join(hot.select(key), key, "left_anti").join(rest, key)
    return left.join(hot, key).unionByName(few)

"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: U+0020 and U+0009 to U+000D, in Java's regular expressions.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row.

    A column that a lambda refers to is otherwise inlined and computed again
    for each element, which makes linear work quadratic.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster's shared folder; a folder of our own only where none is set and one machine does all, as in tests."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = context.getConf().get("spark.checkpoint.dir")
    if shared is None and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="gridlark-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder and read from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df, written as Parquet beside the checkpoints and read from there: columnar, and safe from lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows (some 24 bytes) up to which a table is broadcast, by its count.
BROADCAST_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """df, which is stored and has a few numbers in a row; marked for broadcast if its count is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *caches: Callable[[], None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, whose worker gives memory back when its partition ends.

    Workers outlive their tasks and wait for others; what they hold then is an
    executor's memory all the same.  caches are called to empty what run filled.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for empty in caches:
                empty()
            give_back()

    return tidied


def give_back() -> None:
    """Free memory of Arrow's pool and of the C library, back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass

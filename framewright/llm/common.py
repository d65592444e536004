"""What several text operators share: reading tables, bounded Arrow batches and cutting lineage."""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch between the JVM and Python; very long texts make smaller batches.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Bits of an id filter at most; beyond some millions of ids it lets more rows through, and never fewer than it must.
FILTER_BITS = 1 << 26


#: Bytes from which on a worker's memory comes straight from the system, and unused bytes that it may keep otherwise.
LARGE, UNUSED = 4 << 20, 8 << 20


def _keep_little() -> None:
    """Lets a Python worker give freed memory back at once: workers live on between tasks, next to an executor's heap."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, LARGE)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, UNUSED)  # M_TRIM_THRESHOLD
    except (AttributeError, OSError):  # not every C library has it
        pass


if TaskContext.get() is not None:  # imported by a worker
    _keep_little()


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def bounded_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at a time, whatever the length of the texts; a session's own smaller bounds stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        own = spark.conf.get(key)
        if not own.isdigit() or not 0 < int(own) <= most:
            spark.conf.set(key, most)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir, or the checkpoint folder the session has been given otherwise.

    Where neither is set, a session in one process, as in tests, gets a folder of its machine; a cluster gets an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors and the driver share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="framewright-"))
    return named or context._jsc.sc().getCheckpointDir().get()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and returns what was written."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def fresh_columns(df: DataFrame, *names: str) -> None:
    """Raises an error if ``df`` already has one of the columns that an operator is about to add."""
    taken = {c.lower() for c in df.columns}
    if clash := [n for n in names if n.lower() in taken]:
        raise ValueError(f"the input already has the columns {clash}: rename them or choose other names for the result")


def release_memory() -> None:
    """Gives freed memory of a Python worker back to the machine, since workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def give_back(spark: SparkSession) -> None:
    """Lets executors collect their heap and give what they don't use back to their machines, where Python workers need it.

    A heap that a stage has grown stays as it is otherwise. One short task a core; it changes no result.
    """
    cores = spark.sparkContext.defaultParallelism
    collected = F.call_function("java_method", F.lit("java.lang.System"), F.lit("gc"))
    spark.range(0, cores, 1, cores).select(collected.alias("gc")).write.format("noop").mode("overwrite").save()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_filter(ids: DataFrame) -> Callable[[Column], Column]:
    """A test that holds for all of ``ids`` (one bigint column) and for few other numbers; its size is bounded."""
    (name,) = ids.columns
    words = min(FILTER_BITS, max(1 << 12, 1 << (16 * ids.count()).bit_length())) // 64

    def bits(c: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(c, F.lit(k)), F.lit(words * 64)) for k in range(2)]

    bit = F.col("__framewright_bit")
    mask = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")))
    found = ids.select(F.explode(F.array(*bits(F.col(name)))).alias("__framewright_bit")).groupBy((bit / 64).cast("long").alias("w")).agg(mask.alias("m")).toArrow()  # FILTER_BITS / 64 rows at most
    table_ = np.zeros(words, np.int64)
    table_[found.column("w").to_numpy()] = found.column("m").to_numpy()
    shared = ids.sparkSession.sparkContext.broadcast(table_.view(np.uint64))

    @F.arrow_udf("boolean")
    def maybe(p: pa.Array, q: pa.Array) -> pa.Array:
        out = np.ones(len(p), bool)
        for x in (p, q):
            at = x.to_numpy(zero_copy_only=False)
            out &= ((shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
        return pa.array(out, pa.bool_())

    return lambda c: maybe(*bits(c))

"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Largest side, in bytes, that an operator broadcasts; beyond it the join shuffles.
BROADCAST_BYTES = 64 << 20

ARROW_ROWS = 1000

#: What a worker remembers for its later tasks, by the operator that it is for.
_MEMORY: dict[str, dict] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a local one only where the session names none and all run in one process."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="quillon-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, with its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder; removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def remove() -> None:
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # the JVM has gone, and took the session with it
            return

    atexit.register(remove)
    return path


def bucketed(df: DataFrame, key: str, least: int = 64) -> DataFrame:
    """df, written once to the shared folder in buckets of key, so that grouping by it moves no row again."""
    spark = df.sparkSession
    path, buckets = scratch(spark, "table"), max(least, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"quillon_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", path).option("compression", "none").bucketBy(buckets, key).saveAsTable(name)
    return spark.table(name)


def lean(docs: DataFrame) -> DataFrame:
    """docs, with whole texts going to Python at most `ARROW_ROWS` at a time in this session."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= ARROW_ROWS:
        conf.set(name, ARROW_ROWS)
    return docs


def memory(operator: str) -> dict:
    """What this process remembers for later tasks of an operator; what it does for others goes."""
    for other in _MEMORY.keys() - {operator}:
        del _MEMORY[other]
    return _MEMORY.setdefault(operator, {})


def tidy(operator: str = "") -> None:
    """Gives a process's free memory back, and what it remembers for other operators: workers wait for later tasks, and others start beside them."""
    memory(operator)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        return


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove checkpoints, shuffles and broadcasts that nothing refers to: it learns of them when the driver's JVM collects."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def broadcast_if(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """A broadcast hint if rows of row_bytes fit the bound, else df for a shuffled join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def quoted(df: DataFrame, *names: str) -> list[Column]:
    """Columns of df by name, all by default, whatever stands in the names."""
    return [F.col(f"`{n.replace('`', '``')}`") for n in names or df.columns]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def partition_offsets(df: DataFrame, part: str, count: Column) -> tuple[DataFrame, int]:
    """(part, offset): the sum of count over all lower parts. One row per partition reaches the driver."""
    spark = df.sparkSession
    rows = sorted((r[0], r[1]) for r in df.groupBy(part).agg(count.cast("long")).collect())
    starts, total = [], 0
    for p, n in rows:
        starts.append((p, total))
        total += n
    return spark.createDataFrame(starts, f"{part} long, _offset long"), total


def number_rows(df: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """df with row_no long from 0 in the given order, and the row count.

    A range shuffle sorts the rows; it is stored, so that a lost executor can't deal the rows
    anew between the counting and the numbering. Rows equal in all of order are interchangeable; the
    place they come from divides them among tasks.
    """
    placed = df.withColumn("_place", F.monotonically_increasing_id())
    ranged = stored(placed.repartitionByRange(*order, "_place").sortWithinPartitions(*order).drop("_place").withColumn("_mid", F.monotonically_increasing_id()))
    parts = ranged.withColumn("_part", F.shiftright("_mid", 33))
    offsets, total = partition_offsets(parts, "_part", F.count("*"))
    numbered = parts.join(broadcast_if(offsets, parts.rdd.getNumPartitions(), 16), "_part")
    return numbered.withColumn("row_no", F.col("_offset") + F.col("_mid").bitwiseAND((1 << 33) - 1)).drop("_part", "_mid", "_offset"), total


def mix64(x: np.ndarray, key: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x.astype(np.uint64) + np.uint64((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x

"""Scratch tables in the cluster's shared folder and connected components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a local default only where it is unset."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        given = "/tmp/checkpoints"
    return given.rstrip("/")


#: Bytes of text that travel between Spark and a Python worker at once.  Buffers double as they grow, and
#: Arrow's pools in an executor keep what they took; a few kernels' chunks are enough.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to ``BATCH_BYTES``, so that long texts cost little memory."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if not now.endswith("b") or not now[:-1].isdigit() or int(now[:-1]) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over batches, giving freed memory back to the system when a task ends.

    Python workers are reused by later stages; without this each keeps its high-water mark.
    """

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    """Freed memory goes back to the system, where the platform can do that."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    Cuts the lineage: a lost executor costs no more than the tasks it ran, since
    the table can be read from any machine.  It goes when the driver ends, or by
    :func:`discard`.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    table = spark.read.schema(schema).parquet(path)
    table.staged_at = path
    return table


def discard(table: DataFrame) -> None:
    """Removes a table of :func:`staged` that no frame reads any more."""
    spark = table.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(table.staged_at)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of ``links``; component is the smallest reachable node.

    Alternating star contraction: each round hangs every neighbour of a node on the
    smallest node of its neighbourhood, first the larger neighbours, then the smaller
    ones.  Paths shrink geometrically, so the rounds grow with the logarithm of the
    longest path.  Edges stay distributed; a round ends in a table in the shared folder.
    Joins are merge joins, so that the driver builds no hash tables round after round.
    """
    def settled(e: DataFrame) -> tuple[DataFrame, tuple]:
        """The edges as a table, and their count and hash, observed while they are written."""
        seen = Observation()
        table = staged(e.observe(seen, F.count(F.lit(1)).alias("n"), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))").alias("h")), "cc")
        return table, (seen.get["n"], seen.get["h"])

    edges, seen = settled(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low.hint("merge"), "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where("u <> v")
            .distinct()
        )
        last = edges
        edges, now = settled(small)
        discard(last)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

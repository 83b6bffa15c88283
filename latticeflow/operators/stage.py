"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def kept(df: DataFrame) -> DataFrame:
    """``df`` checkpointed to the shared folder ``spark.checkpoint.dir`` (a local one only where unset).

    A lost executor costs its running tasks only; the files go when the frame does if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints")
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints"
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return place.toString()

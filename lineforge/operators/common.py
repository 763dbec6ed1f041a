"""Shared helpers: size-checked broadcast and lineage cuts."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

# A side is broadcast only when a bounded count proves it small; otherwise
# the planner (with AQE) picks a shuffle join at run time.
BROADCAST_MAX_ROWS = 200_000


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """``broadcast(df)`` when it has at most ``max_rows`` rows, else ``df``.

    The check reads at most ``max_rows + 1`` rows, so it is cheap even when
    the side turns out to be large.
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def cut_lineage(df: DataFrame, name: str | None = None, eager: bool = True) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and return the re-read frame.

    Uses a reliable ``checkpoint()`` (never a local one), so losing an executor
    after this point does not recompute the upstream stages.
    """
    scratch_path(df.sparkSession, name or "ckpt")  # makes sure a checkpoint dir is set
    return df.checkpoint(eager=eager)


def kept(df: DataFrame, name: str) -> DataFrame:
    """``cut_lineage`` for a row per archive entry: a checkpoint writes rows as they are, Parquet's columns take
    little of the paths and names that neighbouring rows share.  Shuffle files that led to them are let go."""
    spark = df.sparkSession
    out = scratch_path(spark, f"{name}/{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(out)
    drop_shuffles(spark)
    return spark.read.schema(df.schema).parquet(out)


def drop_shuffles(spark: SparkSession) -> None:
    """Asks the driver to collect its garbage, so that Spark deletes the shuffle files of queries that ended."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition when the input has fewer partitions than cores.

    A small delivery (or a single unsplittable gzip file / parquet row group)
    arrives as one partition, which would run all per-line work in one task.
    Large inputs already have many splits and pass through unchanged, so no
    shuffle is added at scale.
    """
    spark = df.sparkSession
    target = min_partitions or spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df

"""Spreading small inputs before Python-batch work.

A table stored as one large row group is read as one non-empty partition; a
per-row Python step (embedding, subword encoding, kNN scoring) would then run
in a single task. ``spread`` hash-partitions such an input over the cluster's
default parallelism. Inputs whose estimated size gives every core a full scan
split (the usual case for large tables) are returned unchanged, so no shuffle
is added there. The estimate is the optimizer's: no job runs to decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Size of a scan split by Spark's default.
SPLIT_BYTES = 128 << 20


def spread(df: DataFrame, key: str | None = None, min_partitions: int | None = None
           ) -> DataFrame:
    n = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if estimate >= n * SPLIT_BYTES:
        return df
    return df.repartition(n, F.col(key)) if key else df.repartition(n)


#: Text and rows that a Python step takes at a time out of an Arrow batch (of up to 10,000 rows and 64 MB).
SLICE_BYTES = 512 << 10
SLICE_ROWS = 512


def slices(batch: pa.RecordBatch, text_col: str, max_bytes: int = SLICE_BYTES, max_rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows of at most ``max_rows`` rows and, beyond one row, ``max_bytes`` of text: what a step
    builds per row or token (objects many times the text) is bounded whatever the batch holds."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = min(start + max_rows, max(start + 1, int(np.searchsorted(ends, before + max_bytes, side="right"))))
        yield batch.slice(start, stop - start)
        start = stop


#: Bytes of an Arrow batch inside ``bounded_batches``.
BATCH_BYTES = 8 << 20


@contextmanager
def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES) -> Iterator[None]:
    """Jobs that run inside hand at most ``most`` bytes at a time to Python (Spark's default: 10,000 rows of any length up to 64 MB)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(most, int(before)) if before.isdigit() and int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Bytes of an Arrow batch of a step that takes it in slices.
SMALL_BYTES = 2 << 20


def small_batches(spark: SparkSession, most: int = SMALL_BYTES) -> None:
    """From now on the session's Arrow batches hold ``most`` bytes at most, for results that run after their function has returned."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    if not (before.isdigit() and 0 < int(before) <= most):
        spark.conf.set(name, str(most))


def global_positions(ordered: DataFrame, name: str = "_gpos") -> DataFrame:
    """0-based position of every row in the DataFrame's (sorted) order, natively.

    Each row's index inside its partition comes from
    ``monotonically_increasing_id`` (partition id in the upper bits); the start
    of every partition is the running sum of the partition sizes, a table of
    one row per partition that is broadcast back. The ordered data is
    checkpointed first (shared checkpoint folder) so both passes see the same
    partitions.
    """
    s = (ordered.withColumn("_pid", F.spark_partition_id())
         .withColumn("_local", F.monotonically_increasing_id()
                     - F.shiftleft(F.spark_partition_id().cast("long"), 33))
         .checkpoint())
    sizes = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    from pyspark.sql import Window
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_pid", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_start"))
    return (s.join(F.broadcast(starts), "_pid")                     # one row per partition
            .withColumn(name, F.col("_start") + F.col("_local"))
            .drop("_pid", "_local", "_start"))

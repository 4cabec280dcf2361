"""Incremental batch classification with Structured Streaming.

Activity files arriving in a folder are read by the file source, a few files
per micro-batch; each micro-batch is classified with the batch job (G11) in
``foreachBatch`` and written under its batch id, so a replayed micro-batch
overwrites its own output (idempotent). The rows that a micro-batch read and wrote are
observed while it runs, without a further pass; its progress is a row of a table beside
the output, also if it is empty or fails. A failed micro-batch ends the run with the state
``failed``; the next run starts with it again. No state, watermark or window is needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

INPUT_SCHEMA = "id string, activity_description string"


PROGRESS_SCHEMA = "batch_id bigint, input_rows bigint, output_rows bigint, state string, error string"


def run_classification_stream(spark: SparkSession, input_dir: str, output_dir: str,
                              checkpoint_dir: str,
                              classify: Callable[[DataFrame], DataFrame], *,
                              files_per_trigger: int = 1, fmt: str = "parquet",
                              fail: bool = True) -> list[dict]:
    """Process everything in ``input_dir`` (``trigger(availableNow=True)``) and return the progress of
    the micro-batches of this run: ``batch_id, input_rows, output_rows, state, error``.

    ``fail=False`` returns the progress of a failed run, too, instead of raising its error.
    """
    src = (spark.readStream.schema(INPUT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
           .format(fmt).load(input_dir))
    progress: list[dict] = []           # a row per micro-batch

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        read, written = Observation(f"read-{batch_id}"), Observation(f"written-{batch_id}")
        count = F.count(F.lit(1)).alias("n")
        row = {"batch_id": batch_id, "input_rows": None, "output_rows": None, "state": "failed", "error": None}
        progress.append(row)
        try:
            out = classify(batch.observe(read, count)).withColumn("batch_id", F.lit(batch_id))
            out.observe(written, count).write.mode("overwrite").parquet(f"{output_dir}/batch_id={batch_id}")
            row.update(input_rows=read.get.get("n", 0), output_rows=written.get.get("n", 0), state="done")
        except Exception as exc:
            row["error"] = f"{type(exc).__name__}: {exc}".splitlines()[0]
            raise
        finally:
            (spark.createDataFrame([tuple(row.values())], PROGRESS_SCHEMA).coalesce(1).write.mode("overwrite")
             .parquet(f"{_progress_dir(output_dir)}/batch={batch_id}"))

    q = (src.writeStream.foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True).start())
    try:
        q.awaitTermination()
    except StreamingQueryException:
        if fail:
            raise
    return progress


def _progress_dir(output_dir: str) -> str:
    return output_dir.rstrip("/") + "-progress"


def job_progress(spark: SparkSession, output_dir: str) -> DataFrame:
    """Progress of all micro-batches that were ever written to a folder (the last attempt of each)."""
    try:
        return spark.read.parquet(_progress_dir(output_dir)).drop("batch")
    except AnalysisException:
        return spark.createDataFrame([], PROGRESS_SCHEMA)


def read_stream_output(spark: SparkSession, output_dir: str) -> DataFrame:
    return spark.read.parquet(output_dir)

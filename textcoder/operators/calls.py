"""Calls of a remote model from tasks: retries with back-off, isolation of failing rows, a bound on concurrent calls.

A call takes a batch of rows. If it fails, it is tried again after a pause that doubles each time; if the retry budget is spent,
the batch is halved and both halves are called, down to single rows. A row that fails alone keeps its error, the
others their answers, so one bad row costs about ``2 log2(batch)`` further calls and no other row. The calls of a job run in its tasks, one
at a time each: a job has at most as many concurrent calls as partitions, which ``at_most`` bounds.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Retry:
    """``attempts`` calls in all for a batch, pauses of ``pause``, twice ``pause`` and so on seconds, ``longest`` at most."""
    attempts: int = 1
    pause: float = 0.5
    longest: float = 30.0


def answers(call: Callable[[Sequence], Sequence], rows: Sequence, retry: Retry = Retry(), sleep=time.sleep) -> tuple[list, list[str | None]]:
    """Answer and error of each row (one of them None)."""
    error = None
    for attempt in range(max(1, retry.attempts)):
        if attempt:
            sleep(min(retry.longest, retry.pause * 2 ** (attempt - 1)))
        try:
            found = list(call(rows))
            if len(found) != len(rows):
                raise RuntimeError(f"{len(found)} answers for {len(rows)} rows")
            return found, [None] * len(rows)
        except Exception as exc:                # whatever a remote call raises; the rows carry it
            error = f"{type(exc).__name__}: {exc}"
    if len(rows) <= 1:
        return [None] * len(rows), [error] * len(rows)
    half = len(rows) // 2
    left, right = answers(call, rows[:half], retry, sleep), answers(call, rows[half:], retry, sleep)
    return left[0] + right[0], left[1] + right[1]


def at_most(df: DataFrame, concurrent: int | None) -> DataFrame:
    """``df`` in ``concurrent`` partitions at most, so that as many calls at most run at a time."""
    return df if concurrent is None else df.repartition(max(1, concurrent))


def _committed(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)                # a batch's files appear when its write commits
        return True
    except AnalysisException:
        return False


def run_in_batches(spark: SparkSession, rows: DataFrame, out_dir: str, job: Callable[[DataFrame], DataFrame], *, id_col: str = "id",
                   batches: int = 16, retry: Retry = Retry(), sleep=time.sleep) -> DataFrame:
    """``job`` over ``batches`` parts of ``rows`` (by id hash), each committed by itself under ``out_dir/batch=<n>``.

    A batch that is committed is not run again, so a job that was killed resumes at the batch it was in. A batch that fails
    after its retries is left out, and the others go on; run again, it is tried again. Returns a row per batch: batch, state (``done
    before``, ``done``, ``failed``), attempts, error.
    """
    report = []
    for n in range(batches):
        path = f"{out_dir}/batch={n}"
        if _committed(spark, path):
            report.append((n, "done before", 0, None))
            continue
        part, error, used = rows.where(F.pmod(F.xxhash64(id_col), F.lit(batches)) == n), None, 0
        for used in range(1, max(1, retry.attempts) + 1):
            if used > 1:
                sleep(min(retry.longest, retry.pause * 2 ** (used - 2)))
            try:
                job(part).write.mode("overwrite").parquet(path)
                error = None
                break
            except Exception as exc:            # the batch is reported, the others go on
                error = f"{type(exc).__name__}: {str(exc).splitlines()[0] if str(exc) else ''}"
        report.append((n, "failed" if error else "done", used, error))
    return spark.createDataFrame(report, "batch int, state string, attempts int, error string")

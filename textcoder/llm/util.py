"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import functools
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textcoder.session import ensure_checkpoint_dir, work_dir

#: White space of every contract here: space and the controls tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
#: Java / RE2 / Python pattern of one word.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a few numbers that a file of a checkpoint may well hold.
_FILE_ROWS = 200_000


def without_spaces(text: Column) -> Column:
    """``text`` with every character of SPACES deleted (fast byte search, no regular expression)."""
    return functools.reduce(lambda c, s: F.replace(c, F.lit(s), F.lit("")), SPACES, text)


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_interval(*key: Column) -> Column:
    """Reproducible number in (0, 1) from the MD5 of the key, which other engines can repeat."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(k.cast("string"), F.lit("null")) for k in key]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(2.0 ** 52)


def bounded_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Arrow batches of the session hold at most ``most`` bytes, so 10,000 long documents don't meet in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder, so that a lost executor costs no rerun."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def cut_few(df: DataFrame, rows: int = 0) -> DataFrame:
    """``cut`` for a table of one row per source, or of about ``rows`` rows: as many files as there are cores, or more for many rows.

    Such a table would otherwise be a file per shuffle partition, most of them empty, and each new file of a local folder
    costs the executor some child processes. Only the last step's tasks are joined; shuffles keep their partitions.
    """
    return cut(df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, rows // _FILE_ROWS)))


def lookup(df: DataFrame, most: int = 50_000, few: bool = False) -> DataFrame:
    """``df`` checkpointed, with a broadcast hint if it has few rows; larger ones are joined as Spark sees fit. ``few``: by ``cut_few``."""
    small = cut_few(df) if few else cut(df)
    return F.broadcast(small) if small.count() <= most else small


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet to a new shared folder; the table read back, and its path."""
    path = work_dir(df.sparkSession, f"{name}-{uuid.uuid4().hex[:8]}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _scan_only(df: DataFrame) -> bool:
    """Whether each row of ``df`` is a row of one file scan, and none comes twice (no join, union, explode, resampling)."""
    plan = df._jdf.queryExecution().analyzed()
    while not plan.children().isEmpty():
        if plan.nodeName() not in ("Project", "Filter", "SubqueryAlias"):
            return False
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def located(df: DataFrame) -> DataFrame:
    """``df`` with columns in_0, in_1 and so on in place of its own, and a locator: ``__path``, ``__file`` (its hash), ``__row``.

    The locator tells rows apart. It is that of the scan where a row of ``df`` is a row of a file; other frames, in which a
    row of a file may come twice or never, are written once and located in what was written.
    """
    names = [f"in_{i}" for i in range(len(df.columns))]

    def at(rows: DataFrame, columns: list[str]) -> DataFrame:
        path = F.col("_metadata.file_path")
        return rows.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(columns, names, strict=True)], path.alias("__path"),
                           F.xxhash64(path).alias("__file"), F.col("_metadata.row_index").alias("__row"))

    if "_metadata" not in df.columns and _scan_only(df):
        try:
            return at(df, df.columns)
        except AnalysisException:           # a source without row positions
            pass
    back, _ = stored(df.toDF(*names), "content")
    return at(back, names)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")

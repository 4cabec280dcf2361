"""Nomenclature sources (S1, S2) and the nomenclature derived from the ``part`` table.

A raw nomenclature row (R1) has seven string columns
``CODE, HEADING, LEVEL, PARENT_CODE, Includes, IncludesAlso, Excludes`` plus
``row_no``, an order key following the file (used where the last duplicate wins).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_COLUMNS = ("CODE", "HEADING", "LEVEL", "PARENT_CODE", "Includes", "IncludesAlso", "Excludes")


def _conform(df: DataFrame) -> DataFrame:
    cols = [F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
            for c in RAW_COLUMNS]
    return df.select(*[c.alias(n) for c, n in zip(cols, RAW_COLUMNS)],
                     *(["row_no"] if "row_no" in df.columns else []))


def read_nomenclature(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated file with a header; every column read as text (no inference).

    Quoted fields may hold tabs and newlines. ``row_no`` follows the files by name and
    the rows inside a file: Spark packs files into tasks by size, so the file's path leads
    and the running number of its one task (a multi-line file is not split) follows.
    """
    df = (spark.read.option("sep", "\t").option("header", True).option("inferSchema", False)
          .option("multiLine", True).option("quote", '"').option("escape", '"').csv(path))
    return _conform(df.withColumn("row_no", F.struct(F.col("_metadata.file_path").alias("file"),
                                                     F.monotonically_increasing_id().alias("row"))))


def write_nomenclature(rows: DataFrame, path: str) -> None:
    """The seven columns as tab-separated files with a header; blanks at the edges are kept, a null
    is an empty field and an empty text a quoted one."""
    (rows.select(*RAW_COLUMNS).write.mode("overwrite").option("sep", "\t").option("header", True)
     .option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Only ``CODE, HEADING`` (+ order); the scan reads two columns."""
    return read_nomenclature(spark, path).select("CODE", "HEADING", "row_no")


def nomenclature_from_part(part: DataFrame) -> DataFrame:
    """A 4-level nomenclature built from ``part``.

    level 1 ``p_type``; level 2 ``type.brand``; level 3 ``type.brand.size``;
    level 4 ``type.brand.size.partkey`` with heading ``p_name``. Parent = code
    without its last part. Level-4 ``Includes`` is the name padded with blanks
    and tabs, ``IncludesAlso`` holds a two-character ``\\n`` sequence,
    ``Excludes`` is null for even keys. Level-4 codes carry a trailing blank
    (stripped when documents are built).
    """
    p = part.select("p_partkey", "p_name", "p_brand", "p_type",
                    F.col("p_size").cast("string").alias("p_size"))
    c1 = F.col("p_type")
    c2 = F.concat_ws(".", "p_type", "p_brand")
    c3 = F.concat_ws(".", "p_type", "p_brand", "p_size")
    c4 = F.concat_ws(".", "p_type", "p_brand", "p_size", F.col("p_partkey").cast("string"))
    null = F.lit(None).cast("string")
    # Levels 1-3: three rows per part from one scan, one distinct (one shuffle).
    upper_rows = F.array(
        F.struct(c1.alias("CODE"), F.concat(F.lit("Type "), "p_type").alias("HEADING"),
                 F.lit("1").alias("LEVEL"), null.alias("PARENT_CODE")),
        F.struct(c2.alias("CODE"), F.concat_ws(" ", "p_brand", "p_type").alias("HEADING"),
                 F.lit("2").alias("LEVEL"), c1.alias("PARENT_CODE")),
        F.struct(c3.alias("CODE"),
                 F.concat_ws(" ", "p_brand", "p_type", F.lit("size"), "p_size").alias("HEADING"),
                 F.lit("3").alias("LEVEL"), c2.alias("PARENT_CODE")))
    upper = (p.select(F.inline(upper_rows)).distinct()
             .withColumn("Includes", null).withColumn("IncludesAlso", null)
             .withColumn("Excludes", null))
    leaves = p.select(
        F.concat(c4, F.lit(" ")).alias("CODE"), F.col("p_name").alias("HEADING"),
        F.lit("4").alias("LEVEL"), c3.alias("PARENT_CODE"),
        F.concat(F.lit("  "), "p_name", F.lit(" \t "), "p_type", F.lit("\t ")).alias("Includes"),
        F.concat(F.col("p_brand"), F.lit("\\nsize "), "p_size").alias("IncludesAlso"),
        F.when(F.col("p_partkey") % 2 == 1, F.concat(F.lit("Other "), "p_type", F.lit(" parts")))
        .alias("Excludes"))
    raw = upper.unionByName(leaves)
    # Derived codes are unique, so this order key never decides between duplicates.
    return _conform(raw.withColumn("row_no", F.xxhash64("LEVEL", "CODE")))

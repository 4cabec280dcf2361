"""Records of CSV text, also quoted ones over several lines, from splittable line scans.

Where a record ends depends on all quotes before it: a line break inside a quoted field does not end one. Instead of reading a
file as one piece, lines are scanned by Spark in splits of any size, and the state of the parser at each line (outside, or inside a
quoted field) is found by a prefix computation. A line with quotes turns the state before it into the one after
it in one of four ways: it keeps the state, swaps it, or leaves the parser outside or inside whatever was before
(fields are parsed as the CSV rules say: a quote opens a field only at its start, a doubled quote is content, and what follows a closing
quote up to the delimiter is content, too). So the state before a line is the one that the last deciding line before it left, swapped as often as lines
swapped it since. Within a split this is a window over its lines; over splits, a window over one row per split of a file.

Lines that begin outside a field begin a record; the others belong to the record before them, which may have begun in an earlier split.
Only records of several lines are gathered, each by itself. A record must fit into a row (an unclosed quote makes the rest of its file one record).
"""

from __future__ import annotations

import csv
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.partitioning import slices

#: Lines or records that a Python step takes at a time (of at most ``partitioning.SLICE_BYTES``).
SLICE_RECORDS = 4096
KEEP, SWAP, TO_OUTSIDE, TO_INSIDE = range(4)
_ORDER = ("file", "block", "at")


def line_effect(line: str, delim: str) -> int:
    """What a line does to the state of the parser."""
    rules = _rules(delim)
    from_outside = bool(rules[0].fullmatch(line))
    content = rules[1].match(line).end()
    if content == len(line):
        from_inside = True
    else:
        after = line.find(delim, content + 1)
        from_inside = after >= 0 and bool(rules[0].fullmatch(line, after + 1))
    if from_outside == from_inside:
        return TO_INSIDE if from_outside else TO_OUTSIDE
    return SWAP if from_outside else KEEP


_RULES: dict[str, tuple[re.Pattern, re.Pattern]] = {}


def _rules(delim: str) -> tuple[re.Pattern, re.Pattern]:
    """(a line whose last field is quoted and not closed, quoted content) for a delimiter."""
    if delim not in _RULES:
        d = re.escape(delim)
        quoted = r'"[^"]*+(?:""[^"]*+)*+'
        _RULES[delim] = (re.compile(rf'(?:(?:{quoted}"[^{d}]*+|[^"{d}][^{d}]*+)?+{d})*+{quoted}', re.S), re.compile(r'[^"]*+(?:""[^"]*+)*+', re.S))
    return _RULES[delim]


def _sliced(texts: pa.Array, make, kind: pa.DataType) -> pa.Array:
    """``make`` of each text; the Python objects of a slice are gone before the next one is made."""
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    parts = [pa.array([make(x) for x in part.column("text").to_pylist()], kind) for part in slices(batch, "text", max_rows=SLICE_RECORDS)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def _effects(delim: str):
    def run(lines: pa.Array) -> pa.Array:
        return _sliced(lines, lambda x: KEEP if x is None else line_effect(x, delim), pa.int32())

    return F.arrow_udf(run, "int")


def cells(record: Column, delim: str) -> Column:
    """Cells of a record, as Python's csv module reads them."""
    def run(records: pa.Array) -> pa.Array:
        limit = csv.field_size_limit(1 << 31 - 1)
        try:
            return _sliced(records, lambda x: None if x is None else next(csv.reader([x], delimiter=delim), []), pa.list_(pa.string()))
        finally:
            csv.field_size_limit(limit)

    return F.arrow_udf(run, "array<string>")(record)


def _without_mark(value: Column) -> Column:
    """Without a byte order mark; other bytes stay as they are, valid or not."""
    return F.when(value.startswith("\ufeff"), F.substr(value, F.lit(2))).otherwise(value)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, value): lines with their place, in the order of files, splits and lines."""
    return (spark.read.text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("at"), _without_mark(F.col("value")).alias("value")))


def _state(deciding: Column, swaps: Column, start: Column) -> Column:
    """State after a deciding line (its outcome and the swaps up to it, null: none) and ``swaps`` up to now; else from ``start``."""
    since = F.coalesce(swaps, F.lit(0)) - F.coalesce(deciding["swaps"], F.lit(0))
    return (F.coalesce(deciding["inside"], start).cast("int") + since) % 2 == 1


def records(spark: SparkSession, path: str, delim: str) -> DataFrame:
    """(file, block, at, value): the records of all files, placed where they begin."""
    scanned = lines(spark, path).withColumn("effect", _effects(delim)(F.when(F.col("value").contains('"'), F.col("value")))).checkpoint()
    here = Window.partitionBy("file", "block").orderBy("at")
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    swap = (F.col("effect") == SWAP).cast("int")
    # Of each line: the swaps up to it and, if it decides, the outcome.
    marked = (scanned.withColumn("swaps", F.sum(swap).over(here))
              .withColumn("decides", F.when(F.col("effect") >= TO_OUTSIDE, F.struct((F.col("effect") == TO_INSIDE).alias("inside"), "swaps"))))
    # A row per split: what it makes of the state before it.
    splits = marked.groupBy("file", "block").agg(F.max("swaps").alias("swaps"), F.max_by("decides", F.when(F.col("decides").isNotNull(), F.col("at"))).alias("last"))
    in_file = Window.partitionBy("file").orderBy("block")
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    # The same, one level up: a split decides if a line of it does; else it swaps as often as its lines do.
    up = (splits.withColumn("own", F.when(F.col("last").isNotNull(), F.struct(_state(F.col("last"), F.col("swaps"), F.lit(False)).alias("inside"))))
          .withColumn("turns", F.when(F.col("own").isNull(), F.col("swaps")).otherwise(0))
          .withColumn("total", F.sum("turns").over(in_file))
          .withColumn("decides", F.when(F.col("own").isNotNull(), F.struct(F.col("own.inside").alias("inside"), F.col("total").alias("swaps")))))
    starts = up.select(F.col("file").alias("f"), F.col("block").alias("b"),
                       _state(F.last("decides", True).over(earlier), F.coalesce(F.sum("turns").over(earlier), F.lit(0)), F.lit(False)).alias("start"))
    at = marked.join(F.broadcast(starts), (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))        # a row per split
    at = at.withColumn("inside", _state(F.last("decides", True).over(before), F.sum(swap).over(before), F.col("start")))
    ends_open = F.lead("inside").over(here)
    at = (at.withColumn("opens", ~F.col("inside")).withColumn("goes_on", ends_open)
          .withColumn("begin", F.last(F.when(F.col("opens"), F.struct(*_ORDER)), True).over(here))
          .select(*_ORDER, "value", "opens", "goes_on", "begin").checkpoint())
    # Lines before the first record of their split belong to the last record of an earlier one.
    lasts = (at.groupBy(F.col("file").alias("f"), F.col("block").alias("b")).agg(F.max("begin").alias("last"))
             .withColumn("held", F.last("last", True).over(Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)))
             .select("f", "b", "held"))
    # A line is a record by itself if the next line of its split begins another; the last line of a split is looked at with the rest.
    alone = at.where("opens and goes_on = false").select(*_ORDER, "value")
    rest = (at.where("not (opens and coalesce(goes_on, true) = false)")
            .join(F.broadcast(lasts), (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
            .select(F.coalesce("begin", "held").alias("begin"), F.struct(*_ORDER).alias("place"), "value"))
    joined = (rest.groupBy("begin").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("parts"))
              .select("begin.*", F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("value")))
    return alone.unionByName(joined)

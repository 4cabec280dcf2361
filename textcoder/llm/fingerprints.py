"""SimHash document fingerprints, and a search over permuted block tables.

A fingerprint has 64 bits. The terms of a text are its word pairs (a single word stands for itself); a
term weighs ``1 + ln(tf)``, each bit of its hash votes with the weight's sign, and a bit of the fingerprint is
set if the votes for it outweigh those against. The likeness of two texts is the share of equal bits.

Search: the bits are cut into ``radius + tight`` blocks. There is a table for each choice of ``tight`` blocks, in
which the fingerprints are permuted so that these blocks lead and are the table's key. Two fingerprints within
the radius agree on at least ``tight`` blocks, so every neighbour of a query has the query's key in some table;
candidates are verified on all bits. Equal fingerprints are stored once with their count.

Defined cases: null and empty texts have no terms and fingerprint 0; equal texts have equal fingerprints; a very long
text is read whole, a part at a time; columns named like the outputs are replaced.
"""

from __future__ import annotations

import functools
import itertools
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textcoder.llm.hashing import bits, packed, shingle_hashes
from textcoder.llm.util import bounded_batches

TERM_WORDS = 2
RADIUS = 3
_ROWS = 1 << 14


def text_simhash(text: str | None, words: int = TERM_WORDS) -> int:
    parts = list(shingle_hashes(text, words))
    if not parts:
        return 0
    terms, tf = np.unique(np.concatenate(parts), return_counts=True)
    weight, votes = (1 + np.log(tf)).astype(np.float64), np.zeros(64)
    for i in range(0, len(terms), _ROWS):
        votes += weight[i:i + _ROWS] @ bits(terms[i:i + _ROWS])
    # Votes for a bit against half of all weight; the margin keeps rounding from deciding a tie.
    return packed(2 * votes - weight.sum() > 1e-9 * weight.sum())


def simhash(text: Column, words: int = TERM_WORDS) -> Column:
    """Fingerprint of a text column, a long."""
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([text_simhash(t.as_py(), words) for t in texts], pa.int64())

    return F.arrow_udf(run, "long")(text)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits, 0 to 1."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def block_tables(fp: Column, radius: int = RADIUS, tight: int = 1) -> Column:
    """Array of structs (table, lead, rest): the permuted fingerprint of each table, its leading blocks as key."""
    edges = [round(64 * i / (radius + tight)) for i in range(radius + tight + 1)]
    spans = list(itertools.pairwise(edges))

    def gather(of: list[tuple[int, int]]) -> Column:
        parts, shift = [], 0
        for a, b in of:
            value = F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1))
            parts.append(F.shiftleft(value, shift))
            shift += b - a
        return functools.reduce(operator.add, parts) if parts else F.lit(0).cast("long")

    tables = []
    for t, lead in enumerate(itertools.combinations(spans, tight)):
        rest = [s for s in spans if s not in lead]
        tables.append(F.struct(F.lit(t).alias("table"), gather(list(lead)).alias("lead"), gather(rest).alias("rest")))
    return F.array(*tables)


def within_radius(queries: DataFrame, fingerprints: DataFrame, fp: str = "fp", radius: int = RADIUS,
                  tight: int = 2) -> DataFrame:
    """(query, found, distance, copies): every distinct fingerprint within the radius of each distinct query.

    ``copies`` counts the rows of ``fingerprints`` that have the found one. Leads of ``tight`` blocks keep random
    meetings rare: with two of five blocks, 25 of 64 bits agree by chance in one pair of 30 million.
    """
    stored = fingerprints.groupBy(F.col(fp).alias("found")).agg(F.count(F.lit(1)).alias("copies"))
    asked = queries.select(F.col(fp).alias("query")).distinct()
    left = asked.select("query", F.inline(block_tables(F.col("query"), radius, tight))).alias("l")
    right = stored.select("found", "copies", F.inline(block_tables(F.col("found"), radius, tight))).alias("r")
    apart = F.bit_count(F.col("l.rest").bitwiseXOR(F.col("r.rest")))
    return (left.join(right, (F.col("l.table") == F.col("r.table")) & (F.col("l.lead") == F.col("r.lead")) & (apart <= radius))
            .select("query", "found", F.bit_count(F.col("query").bitwiseXOR(F.col("found"))).alias("distance"), "copies")
            .distinct())


def with_next(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """``df`` with ``next_<column>`` of the next row by descending id (after the last: the first).

    Rows move once, to pieces of consecutive ids, whose bounds are ids found by one aggregation over the ids. The row
    after a piece's last one is sent to that piece too. Repeated ids follow each other by text value of
    ``columns``; null ids come last.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    n = 2 * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    at = df.agg(F.percentile_approx(id_col, [i / n for i in range(1, n)], 100 * n).alias("cuts"), F.max(id_col).alias("top")).first()
    cuts = np.array(sorted(set(at["cuts"] or [])), dtype=np.int64)

    def run(ids: pa.Array) -> pa.Array:
        values = ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        return pa.array(np.searchsorted(cuts, values), pa.int32())

    # Piece i holds ids above cuts[i - 1] up to cuts[i]; its first row follows the last row of piece i + 1.
    piece, ident = F.arrow_udf(run, "int")(F.col(id_col).cast("long")), F.col(id_col)
    placed = df.withColumn("__piece", piece)
    edge = F.when(ident.isin([int(c) for c in cuts]), F.col("__piece") + 1) if len(cuts) else F.lit(None).cast("int")
    homes = F.filter(F.array(F.struct(F.col("__piece").alias("piece"), F.lit(0).alias("extra")),
                             F.struct(edge.alias("piece"), F.lit(1).alias("extra")),
                             F.struct(F.when(ident.eqNullSafe(F.lit(at["top"])), F.lit(0)).alias("piece"), F.lit(2).alias("extra"))),
                     lambda h: h["piece"].isNotNull())
    placed = placed.select(*df.columns, F.inline(homes).alias("__home", "__extra"))
    order = Window.partitionBy("__home").orderBy("__extra", ident.desc_nulls_last(), *[F.col(c) for c in columns])
    return (placed.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
            .filter("__extra = 0").drop("__home", "__extra"))

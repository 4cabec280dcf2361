"""Sharding by weighted rendezvous hashing (native).

Every shard draws a number for a record key, ``-ln(u) / weight`` with ``u`` from a hash of key and
shard, and the record goes to the smallest. The draw of one shard does not depend on the others:
a further shard only takes the records for which its own draw is smallest, and a shard's part of all
records is proportional to its weight. The key alone decides, so a hot source or a group of equal
texts spreads like any other records. No shuffle is needed to assign; numbering the records inside
a shard (``slots``) counts per (shard, input partition) first, so no task ever holds a shard.

Defined cases: a null key is a key like any other (all its rows share a shard); repeated keys share
a shard and have different slots; a null text has size 16 (0 bytes) and CRC-32 0; an empty table
gives an empty result; columns named like the outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textcoder.llm.util import cut

SEED = 20_240_601
#: Bytes that a record takes beside its text.
HEADER_BYTES = 16


def _draw(key: Column, shard: int, weight: float, seed: int) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(shard), key), 11)
    u = (bits + F.lit(0.5)) / F.lit(2.0 ** 53)
    return F.struct((-F.log(u) / F.lit(float(weight))).alias("draw"), F.lit(shard).alias("shard"))


def rendezvous(key: Column, weights: int | Sequence[float], seed: int = SEED) -> Column:
    """Shard of a record key: an int column; ``weights`` is a shard count or a weight per shard (> 0)."""
    w = [1.0] * weights if isinstance(weights, int) else list(weights)
    if not w or min(w) <= 0:
        raise ValueError("shards need positive weights")
    draws = [_draw(key, i, x, seed) for i, x in enumerate(w)]
    return (F.least(*draws) if len(draws) > 1 else draws[0])["shard"]


def record_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(HEADER_BYTES)).cast("long")


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def slots(df: DataFrame, shard: str = "shard", order: Sequence[str] = (), out: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without a gap.

    Rows are numbered inside (shard, input partition); the start of each such part is the running
    sum of a table with one row per part. The rows are checkpointed first, so that both passes see
    the same partitions; project to slim columns before.
    """
    part, start = "__part", "__start"
    rows = cut(df.withColumn(part, F.spark_partition_id()))
    sizes = rows.groupBy(shard, part).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(shard).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(shard).alias("__s"), F.col(part).alias("__p"),
                          F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(start))
    inside = Window.partitionBy(shard, part).orderBy(*(order or [shard]))
    numbered = rows.withColumn("__k", F.row_number().over(inside) - 1)
    return (numbered.join(starts, (F.col(shard) == F.col("__s")) & (F.col(part) == F.col("__p")))
            .withColumn(out, (F.col(start) + F.col("__k")).cast("long"))
            .drop("__s", "__p", "__k", part, start))


def shard_documents(df: DataFrame, weights: int | Sequence[float] = 40, id_col: str = "doc_id",
                    text_col: str = "text", seed: int = SEED) -> DataFrame:
    """Placement table: id, size, text_crc32, law, shard, slot, and the shard with one more (weight 1)."""
    w = [1.0] * weights if isinstance(weights, int) else list(weights)
    slim = df.select(df[id_col].alias("doc_id"), record_size(df[text_col]).alias("size"),
                     text_crc32(df[text_col]).alias("text_crc32"),
                     rendezvous(df[id_col], w, seed).alias("shard"),
                     rendezvous(df[id_col], [*w, 1.0], seed).alias("grown_shard"))
    return (slots(slim, "shard", ["doc_id", "text_crc32", "size"])
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"))

"""Seeded samples and exact-size splits.

Rows are ordered by ``h = first 15 hex digits of md5(seed ':' key)`` (60 bits):
a deterministic shuffle that DuckDB reproduces with the same ``md5``.

* ``sample(df, n)``: the n smallest ``h`` — ``orderBy().limit()`` plans as a
  per-partition top-n plus a merge of n rows per partition.
* ``split(df, fractions)``: exact sizes without a global window. The k-th
  smallest ``h`` is found by successive 16-bit prefix histograms (each pass is
  one aggregation whose result is at most 65,536 rows); rows are then assigned
  to a split by comparing ``h`` with the thresholds, a plain filter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_BITS = 60
_STEP = 16


def order_hash(key, seed: int | str = 42) -> Column:
    """Deterministic 60-bit order key of a column (non-negative bigint)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string"))), 1, 15),
                   16, 10).cast("bigint")


def sample(df: DataFrame, n: int, key: str, seed: int | str = 42) -> DataFrame:
    """N rows without replacement, the same for the same seed."""
    return df.withColumn("_h", order_hash(key, seed)).orderBy("_h", key).limit(n).drop("_h")


def kth_smallest(df: DataFrame, hcol: str, ks: list[int]) -> dict[int, int]:
    """Value of the k-th smallest (1-based) ``hcol`` for each k, by prefix histograms.

    Each pass narrows every target to one 16-bit prefix bucket; the data is
    scanned once per pass (4 passes for 60 bits at most).
    """
    spark = df.sparkSession
    h = df.select(F.col(hcol).alias("h"))
    # state per target: (prefix value fixed so far, bits fixed, rank inside the prefix)
    state = {k: (0, 0, k) for k in ks}
    out: dict[int, int] = {}
    while len(out) < len(ks):
        open_ = {k: s for k, s in state.items() if k not in out}
        bits = min(_STEP, HASH_BITS - next(iter(open_.values()))[1])
        fixed = next(iter(open_.values()))[1]
        shift = HASH_BITS - fixed - bits
        prefixes = sorted({s[0] for s in open_.values()})
        sub = h
        if fixed:
            sub = h.where(F.shiftright("h", HASH_BITS - fixed).isin(prefixes))
        hist = (sub.groupBy(F.shiftright("h", HASH_BITS - fixed).alias("p") if fixed
                            else F.lit(0).cast("bigint").alias("p"),
                            F.shiftright("h", shift).bitwiseAND((1 << bits) - 1).alias("b"))
                .agg(F.count(F.lit(1)).alias("n")).collect())   # <= len(prefixes) x 65,536 rows
        by_prefix: dict[int, list[tuple[int, int]]] = {}
        for r in hist:
            by_prefix.setdefault(int(r["p"]), []).append((int(r["b"]), int(r["n"])))
        for k, (pref, _, rank) in open_.items():
            acc = 0
            for b, n in sorted(by_prefix.get(pref, [])):
                if acc + n >= rank:
                    new_pref = (pref << bits) | b
                    if fixed + bits >= HASH_BITS:
                        out[k] = new_pref
                    state[k] = (new_pref, fixed + bits, rank - acc)
                    break
                acc += n
            else:
                raise ValueError(f"rank {k} is beyond the number of rows")
    _ = spark
    return out


def split_sizes(n: int, fractions: tuple[float, ...]) -> list[int]:
    """Sizes of successive splits: like two ``train_test_split`` calls, the held-out
    part of each step is rounded up (70/15/15 = 0.30 held out, then half of it)."""
    sizes, rest = [], n
    remaining = 1.0
    for f in fractions[:-1]:
        held_out_share = 1.0 - f / remaining
        held = math.ceil(round(held_out_share * rest, 9))
        sizes.append(rest - held)
        rest = held
        remaining -= f
    sizes.append(rest)
    return sizes


def split(df: DataFrame, key: str, fractions=(0.70, 0.15, 0.15),
          names=("train", "val", "test"), seed: int | str = 42) -> DataFrame:
    """M1: add ``split`` with exact sizes, disjoint and complete, deterministic per seed."""
    if len(fractions) != len(names):
        raise ValueError("one name per fraction")
    hashed = df.withColumn("_h", order_hash(key, seed))
    n = hashed.count()
    sizes = split_sizes(n, tuple(fractions))
    bounds, acc = [], 0
    for s in sizes[:-1]:
        acc += s
        bounds.append(acc)
    ks = [b for b in bounds if 0 < b <= n]
    cut = kth_smallest(hashed, "_h", ks) if ks else {}
    if ks:
        got = hashed.agg(*[F.count_if(F.col("_h") <= F.lit(cut[k])).alias(f"k{k}") for k in set(ks)]).first()
        if any(got[f"k{k}"] != k for k in ks):
            raise ValueError(f"{key} repeats at a boundary: exact sizes need a unique key")
    label = None
    for b, name in zip(bounds, names):
        cond = (F.lit(False) if b == 0 else F.col("_h") <= F.lit(cut[b]))
        label = F.when(cond, F.lit(name)) if label is None else label.when(cond, F.lit(name))
    label = F.lit(names[-1]) if label is None else label.otherwise(F.lit(names[-1]))
    return hashed.withColumn("split", label).drop("_h")

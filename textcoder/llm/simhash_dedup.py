"""SimHash near-dedup with pivot distance tables.

1. Fingerprints (Arrow): bit b of a text's 64-bit fingerprint is set if it is set in over half of the
   hashes of its word shingles. Equal fingerprints are combined first, so exact copies cost one row.
2. Placement: with the bits cut into ``radius + tight`` blocks, two fingerprints within the radius agree on at
   least ``tight`` blocks, so they meet under one choice of blocks (two of six: 15 keys of 21 bits each; more
   blocks give longer keys for larger corpora, with the same links). Keys with one fingerprint go at once.
3. Contraction: three reference fingerprints of each key (least, greatest, a hashed choice) take in
   the members within the radius. These star links are linear in the rows; a dense group of
   near copies becomes one component without its pairs being listed.
4. Pivot distance table: the Hamming distances of each fingerprint to 16 fixed references. Pairs that share
   a key but not a component are discarded if any coordinate differs by more than the radius (triangle
   inequality), the survivors are verified on all 64 bits, under their first common key only.
5. Components of all links; the smallest identifier names a component.

Distances to references lie near 32 for any 64-bit fingerprint, so a pivot table alone keeps over half of all
pairs per coordinate; the block keys decide which rows meet, without losing a link, and the table prunes them.
No bucket is capped; joins on a hot key are split by AQE.

Defined cases: null, empty or blank text has fingerprint 0 and is linked like any other; rows with null
identifiers join components but do not name them (null if there is no other); repeated rows are
linked; an empty table gives an empty result; other columns are passed on by ``deduplicated``.
"""

from __future__ import annotations

import functools
import itertools
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textcoder.llm.graph import components
from textcoder.llm.hashing import bits, packed, shingle_hashes
from textcoder.llm.util import bounded_batches, cut, located

SHINGLE_WORDS = 4
RADIUS = 4
TIGHT = 2
N_PIVOTS = 16
_SALTS = 8


def text_fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    total, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, words):
        total += bits(h).sum(axis=0, dtype=np.int64)
        n += len(h)
    return packed(2 * total > n) if n else 0


def fingerprint(text: Column, words: int = SHINGLE_WORDS) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([text_fingerprint(t.as_py(), words) for t in texts], pa.int64())

    return F.arrow_udf(run, "long")(text)


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def block_masks(blocks: int, tight: int = TIGHT) -> list[int]:
    """The bits of each choice of ``tight`` blocks."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    one = [(1 << b) - (1 << a) for a, b in itertools.pairwise(edges)]
    return [_signed(sum(chosen)) for chosen in itertools.combinations(one, tight)]


def pivots(n: int = N_PIVOTS) -> list[int]:
    """Reference fingerprints: the multiples of a 64-bit odd constant, scrambled."""
    found = []
    for i in range(1, n + 1):
        x = (i * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & ((1 << 64) - 1)
        found.append(_signed(x ^ (x >> 27)))
    return found


def pivot_table(fp: Column, n: int = N_PIVOTS) -> list[Column]:
    """Distances to the references, eight to a long."""
    at = [F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("long") for p in pivots(n)]
    return [functools.reduce(operator.add, [F.shiftleft(d, 8 * j) for j, d in enumerate(at[i:i + 8])])
            for i in range(0, n, 8)]


def _near_in_pivots(left: list[Column], right: list[Column], n: int, radius: int) -> Column:
    def lane(c: Column, j: int) -> Column:
        return F.shiftrightunsigned(c, 8 * j).bitwiseAND(F.lit(255))

    return functools.reduce(operator.and_, [F.abs(lane(left[i // 8], i % 8) - lane(right[i // 8], i % 8)) <= radius
                                            for i in range(n)])


def links(nodes: DataFrame, radius: int = RADIUS, tight: int = TIGHT) -> DataFrame:
    """(node, root) of the distinct fingerprints ``fp`` that have another one within the radius."""
    masks = block_masks(radius + tight, tight)
    keyed = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("no", "part"))
    references = (keyed.groupBy("no", "part")
                  .agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("least"), F.max("fp").alias("most"),
                       F.min_by("fp", F.xxhash64("fp")).alias("some")).filter("n > 1").drop("n"))
    members = cut(keyed.join(references, ["no", "part"]))
    near = F.filter(F.array("least", "most", "some"),
                    lambda r: (F.col("fp") != r) & (F.bit_count(F.col("fp").bitwiseXOR(r)) <= radius))
    star = members.select("fp", near.alias("refs")).filter(F.size("refs") > 0).select("fp", F.explode("refs").alias("ref"))
    taken = components(star.select(F.col("fp").alias("a"), F.col("ref").alias("b")))

    at = (members.select("no", "part", "fp").join(taken, F.col("fp") == F.col("node"), "left")
          .select("no", "part", "fp", F.coalesce("root", "fp").alias("root")))
    open_keys = (at.groupBy("no", "part").agg(F.min("root").alias("x"), F.max("root").alias("y"))
                 .filter("x <> y").select("no", "part"))
    at = at.join(open_keys, ["no", "part"], "left_semi")
    table = pivot_table(F.col("fp"))
    at = cut(at.select("no", "part", "fp", "root", *[c.alias(f"pivot{i}") for i, c in enumerate(table)]))
    le, ri = at.alias("l"), at.alias("r")
    xor = F.col("l.fp").bitwiseXOR(F.col("r.fp"))
    first = F.coalesce(*[F.when(xor.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(masks)])
    pairs = le.join(ri, (F.col("l.no") == F.col("r.no")) & (F.col("l.part") == F.col("r.part"))
                    & (F.col("l.root") < F.col("r.root"))
                    & _near_in_pivots([F.col(f"l.pivot{i}") for i in range(len(table))],
                                      [F.col(f"r.pivot{i}") for i in range(len(table))], N_PIVOTS, radius)
                    & (F.bit_count(xor) <= radius) & (first == F.col("l.no")))
    across = pairs.select(F.col("l.root").alias("a"), F.col("r.root").alias("b")).distinct()
    return components(across.union(taken.select("node", "root")))


def _decided(rows: DataFrame, id_col: str, text_col: str, words: int, radius: int) -> DataFrame:
    """(file, row, id, fp, component_id, kept) of located rows."""
    bounded_batches(rows.sparkSession)
    slim = cut(rows.select(F.col("__file").alias("file"), F.col("__row").alias("row"), F.col(id_col).alias("id"),
                           fingerprint(F.col(text_col), words).alias("fp")))
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "file", "row")
    nodes = cut(slim.groupBy("fp").agg(F.min(first).alias("keep"), F.count(F.lit(1)).alias("copies")))
    linked = links(nodes.select("fp"), radius)
    named = nodes.join(linked, F.col("fp") == F.col("node")).select("fp", "root", "keep")
    names = named.groupBy(F.col("root").alias("name")).agg(F.min("keep").alias("best"))
    keeps = (named.join(names, F.col("root") == F.col("name")).select(F.col("fp").alias("linked_fp"), "best"))
    # A row alone with its fingerprint and without a link stays by itself. The others look up their group under a
    # salt of their own, so that the rows of a large group of copies are spread over tasks.
    groups = (nodes.join(keeps, F.col("fp") == F.col("linked_fp"), "left").filter("copies > 1 or best is not null")
              .select(F.col("fp").alias("node_fp"), F.coalesce("best", "keep").alias("keep"),
                      F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("node_salt")))
    salt = F.pmod(F.xxhash64("file", "row"), F.lit(_SALTS))
    keep = F.coalesce("keep", first)
    return slim.join(groups, (F.col("fp") == F.col("node_fp")) & (salt == F.col("node_salt")), "left").select(
        "file", "row", "id", "fp", keep["id"].alias("component_id"),
        ((F.col("file") == keep["file"]) & (F.col("row") == keep["row"])).alias("kept"))


def _column(df: DataFrame, name: str) -> str:
    """Name of a column of ``df`` in its located form."""
    return f"in_{df.columns.index(name)}"


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS,
                    radius: int = RADIUS) -> DataFrame:
    """One row per row of ``df``: doc_id, fingerprint (16 hex digits), component_id, kept."""
    found = _decided(located(df), _column(df, id_col), _column(df, text_col), words, radius)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id", "kept")


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS,
                 radius: int = RADIUS) -> DataFrame:
    """The rows of ``df``, one of each component (the smallest identifier), with its columns."""
    rows = located(df)
    gone = (_decided(rows, _column(df, id_col), _column(df, text_col), words, radius).filter(~F.col("kept"))
            .select(F.col("file").alias("__gone_file"), F.col("row").alias("__gone_row")))
    left = rows.join(gone, (F.col("__file") == F.col("__gone_file")) & (F.col("__row") == F.col("__gone_row")), "left_anti")
    return left.drop("__path", "__file", "__row").toDF(*df.columns)

"""Filter interaction audit: what each of five filters removes in every order of applying them.

One pass of a table-driven byte transducer (``transducer.py``) measures a text: words, different words, capitals, code points
and symbols. The failures of a text are five bits, A to D from the pass and E from the digests (SHA-256) of all texts:

* A fewer than 200 words; B different words below half of the words; C capitals above 3 % of the code points;
* D one of ``#$%&*|``; E the text of a smaller doc_id, table-wide and whether or not that one is removed.

Everything about orders follows from how many texts of a part have each of the 32 sets of failures: in an order, a filter
removes those that fail it and no earlier one. So documents are summed to at most 32 counts a part, and the 120 orders
are worked out from these. A document's share in the Shapley sum of a filter that it fails along with k - 1 others is 120 / k.

No text, digest or part gathers its rows in a task: equal rows (digest, doc_id, part) are counted map-side first, and whether
a row is a copy is read from per-digest minima of counts, not by joining rows to their group.

Defined cases: null text is empty (an empty text has 0 words, fails A only, and E as a copy); null ``lang`` is the part ``''``; a
null doc_id is larger than all others; rows that repeat a doc_id and its text are no copies of each other; a document
without label counts in ``kept`` and ``removed`` only; of several labels of a document any 1 counts; labels with null doc_id
belong to none; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textcoder.llm.transducer import Pass, blocks
from textcoder.llm.util import bounded_batches, cut

FILTERS = "ABCDE"
MIN_WORDS = 200
#: Different words a word, and capitals a code point, in per cent.
MIN_DISTINCT, MAX_CAPITALS = 50, 3
_BITS = {letter: 1 << i for i, letter in enumerate(FILTERS)}
_MEASURES = ("words", "distinct", "capitals", "points", "symbols")


def measure_all(texts: Iterator[str | None]) -> list[np.ndarray]:
    """The measures of many texts, an array each."""
    found: list[list[np.ndarray]] = [[] for _ in _MEASURES]
    for block in blocks(texts):
        p = Pass(block)
        for column, values in zip(found, (p.words, p.distinct_words(), p.capitals, p.points, p.symbols), strict=True):
            column.append(values)
    return [np.concatenate(c) if c else np.zeros(0, np.int64) for c in found]


def measures(text: Column) -> Column:
    """Struct of words, distinct (words), capitals, points (code points) and symbols of a text; null counts as empty."""
    def run(texts: pa.Array) -> pa.Array:
        columns = [pa.array(c, pa.int64()) for c in measure_all(t.as_py() for t in texts)]
        return pa.StructArray.from_arrays(columns, names=list(_MEASURES))

    return F.arrow_udf(run, ", ".join(f"{m} long" for m in _MEASURES))(text)


def failures(m: Column) -> Column:
    """Bits of the filters A to D that a text with these measures fails."""
    fails = {"A": m["words"] < MIN_WORDS, "B": 100 * m["distinct"] < MIN_DISTINCT * m["words"],
             "C": 100 * m["capitals"] > MAX_CAPITALS * m["points"], "D": m["symbols"] > 0}
    return functools.reduce(operator.add, [F.when(c, F.lit(_BITS[k])).otherwise(0) for k, c in fails.items()])


def failed(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part by the set of filters that they fail."""
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.unhex(F.sha2(text, 256)).alias("digest"), failures(measures(text)).alias("mask"))
    once = cut(slim.groupBy("digest", "id", "part", "mask").agg(F.count(F.lit(1)).alias("n")))
    marks = (labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id"))
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    rows = (once.join(marks, F.col("id") == F.col("label_id"), "left")
            .select("digest", F.struct(F.col("id").isNull().alias("no_id"), "id").alias("id"), "part", "mask", "n",
                    F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")))
    # Copies need no row-wise look-up: of the rows that share all but the id, those with the least id of the digest are no copies.
    alike = rows.groupBy("digest", "part", "mask", "good", "toxic", "id").agg(F.sum("n").alias("n"))
    alike = (alike.groupBy("digest", "part", "mask", "good", "toxic")
             .agg(F.min("id").alias("least"), F.min_by("n", "id").alias("n_least"), F.sum("n").alias("n")))
    alike = cut(alike)
    firsts = alike.groupBy("digest").agg(F.min("least").alias("first")).withColumnRenamed("digest", "of")
    at = alike.join(firsts, F.col("digest") == F.col("of"))
    originals = F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    both = at.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("mask").alias("mask"), originals.alias("n")),
        F.struct((F.col("mask") + _BITS["E"]).alias("mask"), (F.col("n") - originals).alias("n")))).alias("x"))
    return (both.groupBy("part", F.col("x.mask").alias("mask"))
            .agg(F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("good")).alias("good"),
                 F.sum(F.col("x.n") * F.col("toxic")).alias("toxic")))


def orders(sums: DataFrame) -> DataFrame:
    """Part, filter_order, step and the eight counts, from the sums of ``failed``."""
    sets = range(1 << len(FILTERS))
    names = [f"{what}{m}" for what in ("n", "good", "toxic") for m in sets]
    wide = sums.groupBy("part").agg(*[F.sum(F.when(F.col("mask") == m, F.col(what)).otherwise(0)).alias(f"{what}{m}")
                                      for what in ("n", "good", "toxic") for m in sets])
    wide = cut(wide.select("part", F.array(*names[:32]).alias("n"), F.array(*names[32:64]).alias("good"),
                           F.array(*names[64:]).alias("toxic")))
    steps = [F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(i + 1).alias("step"), F.lit(_BITS[order[i]]).alias("own"),
                      F.lit(sum(_BITS[x] for x in order[:i])).alias("before"))
             for order in itertools.permutations(FILTERS) for i in range(len(FILTERS))]
    at = wide.select("part", "n", "good", "toxic", F.explode(F.array(*steps)).alias("s"))

    def total(counts: str, holds) -> Column:
        """Sum over the sets of failures for which ``holds`` is true."""
        kept = F.transform(F.col(counts), lambda x, m: F.when(holds(m.cast("int")), x).otherwise(F.lit(0).cast("long")))
        return F.aggregate(kept, F.lit(0).cast("long"), lambda a, b: a + b)

    def has(m: Column, bits: Column) -> Column:
        return m.bitwiseAND(bits) != 0

    own, before = F.col("s.own"), F.col("s.before")
    here = lambda m: has(m, own) & ~has(m, before)          # noqa: E731
    share = F.transform(F.col("n"), lambda x, m: F.when(has(m.cast("int"), own), x * F.floor(F.lit(120) / F.bit_count(m)))
                        .otherwise(F.lit(0).cast("long")))
    return at.select(
        "part", "s.filter_order", "s.step",
        total("n", lambda m: ~has(m, own.bitwiseOR(before))).alias("kept"), total("n", here).alias("removed"),
        total("n", lambda m: has(m, own) & has(m, before)).alias("redundant"), total("n", lambda m: m == own).alias("unique_fails"),
        total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"),
        F.aggregate(share, F.lit(0).cast("long"), lambda a, b: a + b).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step."""
    return orders(failed(docs, labels, id_col, text_col, part_col))

"""Source divergence audit: how the sources of a language differ in their use of terms, by one-hot level products.

A term is a run of letters A-Z, a-z and characters beyond ASCII, with A-Z lower-cased. Each language keeps the terms that are in at
least ``MIN_DOCS`` of its documents. A group (language, source) gives a kept term that occurs ``c`` times in it the price
``1 + floor(10^9 (c + 1) / (N + V))``; N sums c over the V kept terms. Two groups with prices p and q of a term diverge in it by
``floor((p - q)^2 / q)``.

Pairs of groups: the price of a term depends on its count level alone. Over a block of terms, the matrix X has one indicator
column per (group, level), and ``X' X`` holds, for every pair of groups at once, the joint table: how many terms have level l in
the one and m in the other. Each cell of a joint table is priced once and added up. The product is worked out in tiles of columns.
Its entries are counts of at most ``RARE_BLOCK`` terms, which float32 holds exactly; prices and sums are integers.

Blocks hold terms of like frequency (power of two of the largest count in a group): rare terms, nearly all of a vocabulary,
have few levels, so thousands share a block of a few columns; the few frequent ones go in small blocks. A block is a task's
unit, so a language with most of the text is spread over tasks, and what leaves a block is one sum per pair of groups.

Counting is combined in the task before anything is shuffled (terms of a text as bytes, at most ``FLUSH`` entries held), so a
frequent term or a hot source sends one row per task. Sizes: the result has a row per pair of sources of a language, so the number of sources
of a language must allow its square; the price table (a row per group) is held by one block at a time.

Defined cases: null text, lang or source count as ''; a group without kept terms has N = 0 and is compared like any other; a
language without kept terms has value 0 for all pairs; a language with one source has no pair; ties rank by item;
repeated rows count each time; a very long text is cut between terms; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textcoder.llm.util import bounded_batches, cut, lookup

MIN_DOCS = 3
UNIT = 1_000_000_000
TOP_TERMS = 200
FLUSH = 200_000
#: Terms of a block whose largest count is below / at least RARE.
RARE, RARE_BLOCK, FREQUENT_BLOCK = 16, 4096, 256
TILE = 2048
_PIECE = 1 << 20
#: Bytes of terms stay, A-Z lower-cased; all others become spaces.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of bounded size."""
    raw = (text or "").encode().translate(_TERM_BYTES)
    at = 0
    while at < len(raw):
        end = len(raw) if len(raw) - at <= _PIECE else raw.find(b" ", at + _PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of rows (lang, source, text): occurrences, and documents that hold the term."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, held) in counts.items():
                if n:
                    names = pa.array(list(n), pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(n)), pa.array([source] * len(n)), names, pa.array(list(n.values()), pa.int64()),
                         pa.array([held[t] for t in n], pa.int64())], names=["lang", "source", "term", "n", "docs"])
            counts.clear()

        size = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, held = counts.setdefault((lang, source), (Counter(), Counter()))
                size -= len(n)
                seen: set[bytes] = set()
                for found in terms(text):
                    n.update(found)
                    seen.update(found)
                held.update(seen)
                size += len(n)
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        yield from flush()

    found = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, n, by_source): a row per kept term, with its counts in the sources that have it."""
    return (counts.groupBy("lang", "term")
            .agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("by_source"))
            .filter(F.col("docs") >= min_docs).drop("docs"))


def _level_prices(levels: np.ndarray, total: int) -> np.ndarray:
    return np.array([1 + UNIT * (c + 1) // total for c in levels.tolist()], np.int64)


def joint_tables(level: np.ndarray, tile: int = TILE) -> Iterator[tuple]:
    """Non-zero cells of the joint tables of all pairs of columns of ``level`` (a row per term, a column per group).

    Yields (first groups, their levels, second groups, their levels, terms, whether the mirrored cells are left out).
    """
    columns = [np.unique(level[:, g], return_inverse=True) for g in range(level.shape[1])]
    tiles, width = [[]], 0
    for g, (values, _) in enumerate(columns):
        if tiles[-1] and width + len(values) > tile:
            tiles, width = [*tiles, []], 0
        tiles[-1].append(g)
        width += len(values)

    def indicators(groups: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = [len(columns[g][0]) for g in groups]
        x = np.zeros((len(level), sum(sizes)), np.float32)
        for first, g in zip(np.cumsum([0, *sizes]), groups, strict=False):
            x[np.arange(len(level)), first + columns[g][1]] = 1
        return x, np.repeat(groups, sizes), np.concatenate([columns[g][0] for g in groups])

    for i, left in enumerate(tiles):
        x, xg, xl = indicators(left)
        for j in range(i, len(tiles)):
            y, yg, yl = (x, xg, xl) if i == j else indicators(tiles[j])
            joint = x.T @ y
            a, b = np.nonzero(joint)
            yield xg[a], xl[a], yg[b], yl[b], joint[a, b].astype(np.int64), i != j


def block_divergence(level: np.ndarray, totals: list[int], tile: int = TILE) -> np.ndarray:
    """Sum over the terms of the block of the divergence of group g (row) from group h (column)."""
    n = len(totals)
    value = np.zeros((n, n), np.int64)
    prices = [dict(zip(u.tolist(), _level_prices(u, totals[g]).tolist(), strict=True))
              for g, u in ((g, np.unique(level[:, g])) for g in range(n))]

    def priced(groups: np.ndarray, levels: np.ndarray) -> np.ndarray:
        return np.fromiter((prices[g][c] for g, c in zip(groups.tolist(), levels.tolist(), strict=True)), np.int64, len(groups))

    for g, gl, h, hl, cells, mirrored in joint_tables(level, tile):
        p, q = priced(g, gl), priced(h, hl)
        square = (p - q) ** 2
        np.add.at(value, (g, h), cells * (square // q))
        if mirrored:
            np.add.at(value, (h, g), cells * (square // p))
    return value


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of sources of a language."""
    top = F.array_max(F.transform("by_source", lambda s: s["n"]))
    kept = kept.withColumn("size", F.floor(F.log2(top)).cast("int"))
    limit = F.when(F.col("size") < int(np.log2(RARE)), F.lit(RARE_BLOCK)).otherwise(F.lit(FREQUENT_BLOCK))
    parts = (kept.groupBy("lang", "size").agg(F.count(F.lit(1)).alias("terms"))
             .select(F.col("lang").alias("p_lang"), F.col("size").alias("p_size"), F.ceil(F.col("terms") / limit).alias("parts")))
    at = kept.join(lookup(parts), (F.col("lang") == F.col("p_lang")) & (F.col("size") == F.col("p_size")))
    blocks = at.select("lang", F.concat_ws(":", "size", F.pmod(F.xxhash64("term"), F.col("parts"))).alias("block"), "by_source")
    table = cut(groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("groups")))
    # Block '' has no terms: it gives every pair its row.
    asked = blocks.select("lang", "block").distinct().union(table.select("lang", F.lit("").alias("block")))
    table = asked.join(table, "lang").select(F.col("lang").alias("of"), F.col("block").alias("of_block"), "groups")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lang, listed = right["of"][0].as_py(), right["groups"][0].as_py()
        names, totals = [g["source"] for g in listed], [g["total"] for g in listed]
        level = np.zeros((left.num_rows, len(names)), np.int64)
        if left.num_rows:
            lists = left["by_source"].combine_chunks()
            which = np.repeat(np.arange(left.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            source = pc.index_in(flat.field("source"), value_set=pa.array(names)).to_numpy(zero_copy_only=False)
            level[which, source] = flat.field("n").to_numpy()
        value = block_divergence(level, totals) if left.num_rows else np.zeros((len(names),) * 2, np.int64)
        g, h = np.nonzero(~np.eye(len(names), dtype=bool))
        at = pa.array(names)
        return pa.table({"lang": pa.array([lang] * len(g), pa.string()), "source": at.take(pa.array(g)), "item": at.take(pa.array(h)),
                         "value": pa.array(value[g, h])})

    sums = (blocks.groupBy("lang", "block").cogroup(table.groupBy("of", "of_block"))
            .applyInArrow(run, "lang string, source string, item string, value long"))
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _price(n: str, total: str) -> Column:
    """1 + floor(UNIT (n + 1) / total), exact for any count."""
    wide = "decimal(20, 0)"
    return F.expr(f"1 + CAST({UNIT} * (CAST({n} AS {wide}) + 1) AS decimal(38, 0)) div CAST({total} AS {wide})")


def _terms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of the terms that a source uses more than its language does."""
    small = lookup(groups.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "total", "lang_total"))
    at = kept.select("lang", F.col("term").alias("item"), "n", F.explode("by_source").alias("s"))
    at = at.select("lang", "item", "n", "s.source", F.col("s.n").alias("own"))
    at = (at.join(small, (F.col("lang") == F.col("g_lang")) & (F.col("source") == F.col("g_source")))
          .select("lang", "source", "item", _price("own", "total").alias("p"), _price("n", "lang_total").alias("q")))
    return (at.filter("p > q").select("lang", "source", "item", F.expr("((p - q) * (p - q)) div q").alias("value")))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS,
          top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): parts ``pair`` (all other sources) and ``term`` (up to ``top_terms``)."""
    def filled(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("")).alias({lang: "lang", source: "source"}[c])

    rows = docs.select(filled(lang), filled(source), F.col(text).alias("text"))
    kept = cut(kept_terms(count_terms(rows), min_docs))
    by_group = (kept.select("lang", F.explode("by_source").alias("s")).groupBy("lang", F.col("s.source").alias("source"))
                .agg(F.sum("s.n").alias("n")))
    by_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("lang_n"))
    # A group without terms in a language without kept terms has no price, and none is asked for.
    groups = cut(rows.select("lang", "source").distinct().join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left")
                 .select("lang", "source", (F.coalesce("n", F.lit(0)) + F.coalesce("terms", F.lit(0))).alias("total"),
                         (F.coalesce("lang_n", F.lit(0)) + F.coalesce("terms", F.lit(0))).alias("lang_total")))
    first = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(first).alias("rank"))

    return ranked(_pairs(kept, groups), "pair").union(ranked(_terms(kept, groups), "term").filter(F.col("rank") <= top_terms))

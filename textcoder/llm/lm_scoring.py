"""Language-model scores: online logistic context mixing over bytes, and a unigram base over tokens.

The model (``context_mixing.py``) predicts the decisions of a byte code from hashed contexts; weights and refinement adapt
within each text. What it learns from the corpus is gathered from all training texts:

1. One pass counts tokens and bytes. Counts are combined in the task, then by key, so a frequent token
   sends one row per task. The bytes' counts give the code.
2. A second pass counts the decisions of the code by hashed context; what the word predictor learns follows from the tokens'
   counts. A task's table of counts is cut into slabs, which are sent in
   the narrowest integer that holds them and added up by slab; what is sent grows with the training texts, while a slab's sum is
   one slab, however many tasks there are. The tables of log odds, ``K << bits`` bytes (6 MB), are broadcast.
3. A last pass over all texts scores them. Blocks of texts go through the model together, in bounded memory for any length.

Base: tokens are words and one end; the base score is the sum of ``log10((c + 1) / (N + V + 1))``. The most frequent tokens, at most ``FREQUENT`` of them, are looked up in the scoring pass; the rarer tokens of a text are
joined with their counts (no rare token is a hot key among known ones, and unknown ones add nothing to the numerator).

Defined cases: null and empty text is the end alone (one token); text without a word likewise, though its white space is scored; null
ids are training rows; repeated rows are learnt from and scored each; without training rows N = V = 0, the base score is 0 and
every decision costs one bit at first; columns of the input named like the results are replaced.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textcoder.llm import context_mixing as cm
from textcoder.llm.util import bounded_batches, cut

TABLE_BITS = 21
FREQUENT = 1 << 18
_SLAB = 1 << 14
#: Bytes of words that are counted together in a task.
_COUNTED = 8 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: The end's token; words are never empty.
END_TOKEN = ""


def held_out(id_col: str = "doc_id", parts: int = 7, rest: int = 2) -> Column:
    """Rows not learnt from: CRC-32 of the id as text leaves ``rest`` when divided by ``parts`` (null: learnt from)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == rest, F.lit(False))


def words_of(raws: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All words of lower-cased texts in order, and the bounds of each text's words."""
    data = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    space = _SPACE[data]
    before = np.concatenate([[True], space[:-1]])
    starts, ends = np.flatnonzero(before & ~space), np.flatnonzero(space & ~before)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    # The words one after another, without what is between them.
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[~space])])
    first = np.cumsum([0, *(len(r) + 1 for r in raws)])
    return words, np.searchsorted(starts, first)


def count_tokens(train: DataFrame, text: str = "text") -> DataFrame:
    """(token, symbol, n) over all texts: a row per token (``symbol`` null), and one per byte value and for the end (``token`` null)."""
    bounded_batches(train.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_seen, held, size = np.zeros(cm.END + 1, np.int64), [], 0

        def rows(names, numbers, n) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([names, numbers, n.cast(pa.int64())], names=["token", "symbol", "n"])

        def counted() -> pa.RecordBatch:
            found = pc.value_counts(pa.concat_arrays(held))
            held.clear()
            pa.default_memory_pool().release_unused()
            return rows(found.field("values").cast(pa.string()), pa.nulls(len(found), pa.int32()), found.field("counts"))

        for batch in batches:
            raws = [cm.symbols_of_value(t) for t in batch.column(0)]
            for raw in raws:
                bytes_seen[:cm.END] += np.bincount(np.frombuffer(raw, np.uint8), minlength=cm.END)
            bytes_seen[cm.END] += len(raws)
            held.append(words_of(raws)[0])
            size += held[-1].nbytes
            if size >= _COUNTED:
                yield counted()
                size = 0
        if held:
            yield counted()
        hit = np.flatnonzero(bytes_seen)
        yield rows(pa.nulls(len(hit), pa.string()), pa.array(hit, pa.int32()), pa.array(bytes_seen[hit]))
        # Each text has its end as a token, too.
        yield rows(pa.array([END_TOKEN]), pa.nulls(1, pa.int32()), pa.array(bytes_seen[cm.END:]))

    found = train.select(F.col(text).alias("text")).mapInArrow(run, "token string, symbol int, n long")
    return found.groupBy("token", "symbol").agg(F.sum("n").alias("n"))


def count_contexts(train: DataFrame, counts: DataFrame, code: cm.Code, bits: int = TABLE_BITS, text: str = "text") -> DataFrame:
    """(predictor, slab, odds): log odds of the slots of a slab, as bytes, over the decisions of all texts and of all tokens."""
    bounded_batches(train.sparkSession)
    slab = min(_SLAB, 2 << bits)
    schema = "predictor int, slab int, width int, counts binary"

    def sent(own: cm.Counter) -> Iterator[pa.RecordBatch]:
        for k, table in own.tables.items():
            parts = [(i, p) for i, p in enumerate(table.reshape(-1, slab)) if p.any()]
            width = [next(w for w in (1, 2, 4, 8) if int(p.max()) < 1 << 8 * w) for _, p in parts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * len(parts), pa.int32()), pa.array([i for i, _ in parts], pa.int32()), pa.array(width, pa.int32()),
                 pa.array([p.astype(f"<u{w}").tobytes() for (_, p), w in zip(parts, width, strict=True)], pa.binary())],
                names=["predictor", "slab", "width", "counts"])

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = cm.Counter(code, bits)
        for batch in batches:
            own.add([cm.symbols_of_value(t) for t in batch.column(0)])
        yield from sent(own)

    def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = cm.Counter(code, bits, [cm.WORD])
        for batch in batches:
            own.add_words([w.as_py().encode() for w in batch.column(0)], batch.column(1).to_pylist())
        yield from sent(own)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, i, width, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = sums.setdefault((k, i), np.zeros(slab, np.int64))
                at += np.frombuffer(part, f"<u{width}").astype(np.int64)
        odds = [cm.log_odds(s[0::2], s[1::2]).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in sums], pa.int32()), pa.array([i for _, i in sums], pa.int32()),
                                          pa.array(odds, pa.binary())], names=["predictor", "slab", "odds"])

    parts = (train.select(F.col(text).alias("text")).mapInArrow(of_texts, schema)
             .union(counts.filter(F.col("token") != END_TOKEN).select("token", "n").mapInArrow(of_words, schema)))
    return parts.repartition("predictor", "slab").mapInArrow(add_up, "predictor int, slab int, odds binary")


class Fitted:
    """Token counts (a table), their totals, the frequent tokens, and the mixing model."""

    def __init__(self, counts: DataFrame, total: int, distinct: int, frequent: dict[str, int], model: cm.Model):
        self.counts, self.total, self.distinct, self.frequent, self.model = counts, total, distinct, frequent, model


def _threshold(counts: DataFrame, total: int, most: int, exact: int = 4096) -> int:
    """The least count that at most ``most`` tokens reach (as far as ``exact``; beyond, one token in ``most``)."""
    sizes = counts.groupBy(F.least("n", F.lit(exact)).alias("n")).agg(F.count(F.lit(1)).alias("tokens")).collect()      # ``exact`` rows at most
    least, tokens = max(exact, -(-total // most)) if most else total + 1, 0
    for r in sorted(sizes, key=lambda r: -r["n"]):
        tokens += r["tokens"]
        if tokens > most:
            break
        least = r["n"]
    return least


def fit(train: DataFrame, text: str = "text", bits: int = TABLE_BITS, frequent: int = FREQUENT) -> Fitted:
    """Learn from all rows of ``train``."""
    found = cut(count_tokens(train, text))
    symbols = np.zeros(cm.END + 1, np.int64)
    for r in found.filter("symbol is not null").collect():          # 257 rows at most
        symbols[r["symbol"]] = r["n"]
    counts = found.filter("symbol is null and n > 0").select("token", "n")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    least = _threshold(counts, total, frequent)
    often = {r["token"]: r["n"] for r in counts.filter(F.col("n") >= least).collect()}         # at most ``frequent`` rows
    code = cm.Code(symbols)
    tables = [np.zeros(1 << bits, np.int8) for _ in range(cm.K)]
    for r in count_contexts(train, counts, code, bits, text).toLocalIterator():                        # K << bits bytes in all
        odds = np.frombuffer(r["odds"], np.int8)
        tables[r["predictor"]][r["slab"] * len(odds):(r["slab"] + 1) * len(odds)] = odds
    return Fitted(counts, total, distinct, often, cm.Model(code, tables, bits))


_PARTS = "n_tokens long, known long, part double, rare array<struct<token: string, n: long>>, bits double, n_bytes long"


def _scorer(frequent, model):
    """Arrow function of a text: what ``score`` needs of it."""
    def run(texts: pa.Array) -> pa.Array:
        often, logs = frequent.value
        raws = [cm.symbols_of_value(t) for t in texts]
        bits = [model.value.cost(b) for b in cm.lane_blocks(raws)]
        words, bounds = words_of(raws)
        # The logarithm of each word's count, 0 for words that are not among the frequent ones; the same of the end.
        at = pc.fill_null(pc.index_in(words, value_set=often), len(often)).to_numpy()
        part = logs[at]
        end = logs[pc.fill_null(pc.index_in(pa.array([END_TOKEN.encode()], pa.binary()), value_set=often), len(often))[0].as_py()]
        ends = np.repeat(np.arange(len(raws)), np.diff(bounds))
        rare = np.flatnonzero(at == len(often))
        n_rare = np.bincount(ends[rare], minlength=len(raws)) + (end == 0)
        tokens, times, lists = [], [], [0]
        names, k = words.take(pa.array(rare)).to_pylist(), 0
        for n in n_rare.tolist():
            own = Counter(names[k:k + n - (end == 0)])
            k += n - (end == 0)
            if end == 0:
                own[END_TOKEN.encode()] += 1
            tokens += own.keys()
            times += own.values()
            lists.append(len(tokens))
        sums = [math.fsum(part[a:b].tolist()) + end for a, b in itertools.pairwise(bounds.tolist())]
        n_tokens = np.diff(bounds) + 1
        pairs = pa.StructArray.from_arrays([pa.array(tokens, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())], names=["token", "n"])
        pa.default_memory_pool().release_unused()
        return pa.StructArray.from_arrays(
            [pa.array(n_tokens, pa.int64()), pa.array(n_tokens - n_rare, pa.int64()), pa.array(sums, pa.float64()),
             pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pairs),
             pa.array(np.concatenate(bits) if bits else [], pa.float64()), pa.array([len(r) for r in raws], pa.int64())],
            names=["n_tokens", "known", "part", "rare", "bits", "n_bytes"])

    return F.arrow_udf(run, _PARTS)


def score(df: DataFrame, fitted: Fitted, text: str = "text") -> DataFrame:
    """``df`` without its text, with n_tokens, n_known, train_tokens, base_score, score (log10) and bits_per_byte."""
    spark = df.sparkSession
    bounded_batches(spark)
    outs = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
    kept = [c for c in df.columns if c != text and c not in outs]
    tokens = pa.array([t.encode() for t in fitted.frequent], pa.binary())
    often = spark.sparkContext.broadcast((tokens, np.array([math.log10(c + 1) for c in fitted.frequent.values()] + [0.0])))
    model = spark.sparkContext.broadcast(fitted.model)
    # Internal names, so that no column of the input is taken for one of them.
    slim = cut(df.select(*[F.col(c).alias(f"in_{i}") for i, c in enumerate(kept)], _scorer(often, model)(F.col(text)).alias("of_text")))
    slim = slim.withColumn("rid", F.monotonically_increasing_id())
    rare = slim.select("rid", F.explode("of_text.rare").alias("r")).select("rid", "r.token", F.col("r.n").alias("times"))
    sums = (rare.join(fitted.counts, "token").groupBy(F.col("rid").alias("of"))
            .agg(F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare_part")))
    at = slim.join(sums, F.col("rid") == F.col("of"), "left")
    n_tokens = F.col("of_text.n_tokens")
    base = (F.col("of_text.part") + F.coalesce("rare_part", F.lit(0.0))
            - n_tokens * F.lit(math.log10(fitted.total + fitted.distinct + 1)))
    return at.select(
        *[F.col(f"in_{i}").alias(c) for i, c in enumerate(kept)], n_tokens.alias("n_tokens"),
        (F.col("of_text.known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(fitted.total).cast("long").alias("train_tokens"),
        base.alias("base_score"), (F.col("of_text.bits") * F.lit(-math.log10(2))).alias("score"),
        F.when(F.col("of_text.n_bytes") > 0, F.col("of_text.bits") / F.col("of_text.n_bytes")).alias("bits_per_byte"))

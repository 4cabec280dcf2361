"""Language identification by multilingual mixture inference.

Training counts hashed character n-grams per language over all labelled rows; a language's
n-gram probabilities are smoothed towards the corpus. A document is a bag of n-grams drawn from a mixture of
languages; expectation-maximisation estimates the proportions. The set of languages is selected
by penalised likelihood: starting with all, the language with the smallest proportion is left
out while the log-likelihood falls by less than the penalty of one more language (``log(n) / 2`` times
``penalty``). The prediction is the language with the largest proportion, and the score that proportion.

Only the ratios between the languages' probabilities of an n-gram matter to the proportions, so n-grams
with equal rounded ratios form one profile, and a document is its histogram over profiles. EM is then
a few dense products for a block of documents at a time.

Counting emits at most one row per language and bucket from a task and adds them up by key, so a
language with most rows is no hot key. What reaches the driver and is broadcast is the model: at most
``N_BUCKETS`` rows per language.

Defined cases: null text and text without a letter are ``und`` with score 0; with no labelled row every
text is ``und``; rows with null language are not learnt from; equal proportions go to the first
language by name; a very long text is one bag like any other; repeated rows count as often as they occur.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textcoder.llm.util import bounded_batches

ORDER = 3
N_BUCKETS = 1 << 15
#: Weight of the corpus distribution in a language's n-gram probabilities.
SMOOTHING = 0.01
PENALTY = 4.0
EM_STEPS = 12
UNKNOWN = "und"
_BLOCK_CHARS = 1 << 18
_BLOCK_CELLS = 1 << 19

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Whether a code point is a letter or a mark of one."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 2 - 1)), bool, sys.maxunicode + 1)
    return _LETTER


def grams(texts: list[str], n_buckets: int = N_BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(text index, bucket) of every n-gram: lower case, runs of other characters as one space."""
    lows = [t.lower() for t in texts]
    # A space on either side of each text; runs of spaces are then squeezed to one.
    codes = np.frombuffer((" " + "  ".join(lows) + " ").encode("utf-32-le", "surrogatepass"), dtype="<u4").copy()
    lens = np.fromiter((len(t) + 2 for t in lows), np.int64, len(lows))
    owner = np.repeat(np.arange(len(lows), dtype=np.int32), lens)
    letter = _letters()[codes]
    codes[~letter] = 32
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1] | (owner[1:] != owner[:-1])
    codes, owner = codes[keep].astype(np.uint64), owner[keep]
    if len(codes) < ORDER:
        return owner[:0], codes[:0].astype(np.int32)
    h = codes[: len(codes) - ORDER + 1].copy()
    for k in range(1, ORDER):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k: len(codes) - ORDER + 1 + k]
    h = (h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - int(math.log2(n_buckets)))
    same = owner[: len(h)] == owner[ORDER - 1:]
    return owner[: len(h)][same], h[same].astype(np.int32)


def _blocks(texts: Iterable[str | None]) -> Iterator[list[str]]:
    block, size = [], 0
    for t in texts:
        block.append(t or "")
        size += len(block[-1])
        if size >= _BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def count_grams(train: DataFrame, text: str, lang: str, n_buckets: int = N_BUCKETS) -> DataFrame:
    """(lang, bucket, n) over all rows with a language."""
    rows = train.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).filter("lang is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, at = batch.column(0).to_pylist(), 0
            for block in _blocks(t.as_py() for t in batch.column(1)):
                owner, bucket = grams(block, n_buckets)
                names = sorted(set(langs[at:at + len(block)]))
                which = np.array([names.index(x) for x in langs[at:at + len(block)]])
                both = np.bincount(which[owner] * n_buckets + bucket, minlength=len(names) * n_buckets)
                for name, row in zip(names, both.reshape(len(names), n_buckets), strict=True):
                    sums[name] = sums.get(name, 0) + row
                at += len(block)
        for name, row in sums.items():
            hit = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(hit)), pa.array(hit, pa.int32()), pa.array(row[hit], pa.int64())],
                                             names=["lang", "bucket", "n"])

    return rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Languages, profile of each bucket, and the languages' relative likelihoods of each profile."""

    def __init__(self, counts: dict[str, dict[int, int]], n_buckets: int = N_BUCKETS):
        self.languages, self.n_buckets = sorted(counts), n_buckets
        table = np.zeros((len(counts), n_buckets))
        for i, name in enumerate(self.languages):
            table[i, list(counts[name])] = list(counts[name].values())
        own = table / np.maximum(table.sum(axis=1, keepdims=True), 1)
        corpus = (own.mean(axis=0) + 1e-3 / n_buckets) / (1 + 1e-3)
        p = (1 - SMOOTHING) * own + SMOOTHING * corpus
        ratio = p / p.max(axis=0)
        rounded = np.maximum(np.round(np.log(ratio)), -12).astype(np.int8)
        _, self.profile, size = np.unique(rounded, axis=1, return_inverse=True, return_counts=True)
        self.profile = self.profile.reshape(-1).astype(np.int32)
        mass = p.mean(axis=0)
        total = np.bincount(self.profile, mass, len(size))
        self.likelihood = np.stack([np.bincount(self.profile, ratio[i] * mass, len(size)) / total
                                    for i in range(len(self.languages))], axis=1).astype(np.float32)

    def _em(self, counts: np.ndarray, n: np.ndarray, allowed: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions and log-likelihoods of the rows of ``counts`` with the allowed languages of each row."""
        pi = np.where(allowed, np.maximum(start, 1e-3), 0).astype(np.float32)
        pi /= pi.sum(axis=1, keepdims=True)
        for _ in range(EM_STEPS):
            mix = np.maximum(pi @ self.likelihood.T, 1e-30)
            pi = pi * ((counts / mix) @ self.likelihood) / n[:, None]
        return pi, (counts * np.log(np.maximum(pi @ self.likelihood.T, 1e-30))).sum(axis=1, dtype=np.float64)

    def proportions(self, counts: np.ndarray) -> np.ndarray:
        """A row of language proportions per histogram; rows without n-grams must be left out."""
        n, k = counts.sum(axis=1), len(self.languages)
        allowed = np.ones((len(counts), k), bool)
        pi, fit = self._em(counts, n, allowed, np.full((len(counts), k), 1 / k, np.float32))
        todo = np.arange(len(counts))
        for _ in range(k - 1):
            fewer = allowed[todo].copy()
            fewer[np.arange(len(todo)), np.where(fewer, pi[todo], np.inf).argmin(axis=1)] = False
            again, less = self._em(counts[todo], n[todo], fewer, pi[todo])
            drop = fit[todo] - less <= PENALTY * np.log(np.maximum(n[todo], 2)) / 2
            todo = todo[drop]
            allowed[todo], pi[todo], fit[todo] = fewer[drop], again[drop], less[drop]
            if not len(todo):
                break
        return pi

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, list[np.ndarray]]:
        """Language, score and proportions of each text."""
        names, scores, shares, width = [], [], [], self.likelihood.shape[0]
        for block in _blocks(texts):
            owner, bucket = grams(block, self.n_buckets)
            profile = self.profile[bucket]
            step = max(1, _BLOCK_CELLS // width)
            for i in range(0, len(block), step):
                m = min(step, len(block) - i)
                lo, hi = np.searchsorted(owner, [i, i + m])
                counts = np.bincount((owner[lo:hi] - i) * width + profile[lo:hi], minlength=m * width).reshape(m, width)
                some = counts.sum(axis=1) > 0
                pi = np.zeros((m, len(self.languages)), np.float32)
                if some.any():
                    pi[some] = self.proportions(counts[some].astype(np.float32))
                names += [self.languages[j] if s else UNKNOWN for j, s in zip(pi.argmax(axis=1), some, strict=True)]
                scores.append(np.minimum(pi.max(axis=1), 1).astype(np.float64))
                shares += list(pi)
        return names, np.concatenate(scores) if scores else np.zeros(0), shares


def fit(train: DataFrame, text: str = "text", lang: str = "lang", n_buckets: int = N_BUCKETS) -> Model | None:
    """Learn from all rows of ``train`` with a language; None without any."""
    bounded_batches(train.sparkSession)
    counts: dict[str, dict[int, int]] = {}
    for r in count_grams(train, text, lang, n_buckets).toLocalIterator():
        counts.setdefault(r["lang"], {})[r["bucket"]] = r["n"]
    return Model(counts, n_buckets) if counts else None


def identify(df: DataFrame, model: Model | None, text: str = "text", out: str = "language") -> DataFrame:
    """``df`` with a struct ``out``: lang, score and the proportions of all learnt languages."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        m = shared.value
        values = [t.as_py() for t in texts]
        names, scores, shares = ([UNKNOWN] * len(values), np.zeros(len(values)), [np.zeros(0)] * len(values)
                                 ) if m is None else m.predict(values)
        ends = np.cumsum([0, *map(len, shares)]).astype(np.int32)
        flat = np.concatenate(shares) if shares else np.zeros(0)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.float64), pa.float64()))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), lists],
                                          names=["lang", "score", "proportions"])

    return df.withColumn(out, F.arrow_udf(run, "lang string, score double, proportions array<double>")(F.col(text)))


def held_out(id_col: str = "doc_id"):
    """Rows kept out of training: CRC-32 of the id as text leaves 2 when divided by 4 (null: not)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))

"""Text embedding.

An embedder is any callable ``list[str] -> array (n, dim)``. ``embed`` calls it
once per slice of an Arrow batch inside the executors (``mapInArrow``): no shuffle, rows
stay in their partitions, a slice is at most ``partitioning.SLICE_ROWS`` rows and
``EMBED_BYTES`` of text (L9 chunking). By default a failing slice
is re-raised with the id range of its rows; with ``error_col`` a failing row has a
null vector and its error, and all other rows their vectors (``calls``).

The default ``HashingEmbedder`` needs no model: lower-cased letter/digit tokens,
bucket = first 8 hex digits of the token's MD5 mod ``dim``, counts, L2 norm.
``hashed_counts`` computes the same buckets natively in Spark (explode +
aggregate), which is what the SQL oracle reproduces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokens
from .calls import Retry, answers, at_most
from .partitioning import slices, spread

Embedder = Callable[[Sequence[str]], np.ndarray]

DEFAULT_DIM = 1024
#: Text of one call, at most (beyond one row); a call's vectors are held several times over.
EMBED_BYTES = 4 << 20
#: Estimated bytes of the documents of a partition in ``hashed_counts``.
NATIVE_BYTES = 16 << 20
_TOKEN = r"[\p{L}\p{N}]+"


class HashingEmbedder:
    """Hashed bag of words, L2-normalised; empty text -> zero vector."""

    def __init__(self, dim: int = DEFAULT_DIM):
        self.dim = int(dim)
        self._cache: dict[str, int] = {}
        self._re = None

    def bucket(self, tok: str) -> int:
        b = self._cache.get(tok)
        if b is None:
            b = int(hashlib.md5(tok.encode("utf-8")).hexdigest()[:8], 16) % self.dim
            if len(self._cache) < 200_000:
                self._cache[tok] = b
        return b

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        if self._re is None:
            import regex
            self._re = regex.compile(_TOKEN)
        out = np.zeros((len(texts), self.dim), dtype=np.float64)
        for i, t in enumerate(texts):
            if not t:
                continue
            ids = [self.bucket(w) for w in self._re.findall(t.lower())]
            if ids:
                out[i] = np.bincount(ids, minlength=self.dim)
        norm = np.sqrt(np.einsum("ij,ij->i", out, out))
        nz = norm > 0
        out[nz] /= norm[nz, None]
        return out

    def __getstate__(self):
        return {"dim": self.dim, "_cache": {}, "_re": None}


def _matrix_of(embedder: Embedder, np_type):
    """The embedder as a call on texts that gives one row of a matrix per text."""
    def call(texts):
        mat = np.asarray(embedder([t if t is not None else "" for t in texts]), dtype=np_type)
        if mat.shape[:1] != (len(texts),):
            raise RuntimeError("embedder returned a different number of vectors")
        return mat
    return call


def embed(df: DataFrame, text_col: str, embedder: Embedder | None = None, *,
          out_col: str = "vector", id_col: str | None = None, dtype: str = "double",
          dim: int | None = None, error_col: str | None = None, retry: Retry = Retry(),
          concurrent: int | None = None) -> DataFrame:
    """Append ``out_col array<dtype>`` computed by ``embedder`` on Arrow batches.

    Filters should be applied before this call: Catalyst cannot push them
    through the Python boundary. ``retry`` tries a failing batch again;
    ``error_col`` isolates failing rows instead of failing the job;
    ``concurrent`` bounds the calls that run at a time.
    """
    embedder = embedder or HashingEmbedder(dim or DEFAULT_DIM)
    elem = T.FloatType() if dtype == "float" else T.DoubleType()
    fields = [T.StructField(out_col, T.ArrayType(elem))] + ([T.StructField(error_col, T.StringType())] if error_col else [])
    out_schema = T.StructType(df.schema.fields + fields)
    np_type = np.float32 if dtype == "float" else np.float64
    value_type = pa.float32() if dtype == "float" else pa.float64()
    call = _matrix_of(embedder, np_type)

    def lists(mat: np.ndarray) -> pa.Array:
        ends = np.arange(0, mat.size + 1, mat.shape[1]) if mat.shape[1] else np.zeros(len(mat) + 1)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(mat.reshape(-1), value_type))

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, text_col, EMBED_BYTES)):
            texts = batch.column(text_col).to_pylist()
            found, errors = answers(call, texts, retry) if error_col else _all_or_error(call, texts, retry)
            if errors[0] and not error_col:         # name the rows, keep the cause
                ids = batch.column(id_col).to_pylist() if id_col else None
                where = f" for rows {ids[0]!r}..{ids[-1]!r}" if ids else ""
                raise RuntimeError(f"embedding failed{where}: {errors[0]}")
            if all(e is None for e in errors):
                vec = lists(np.stack(found))
            else:
                vec = pa.array([None if f is None else f.tolist() for f in found], pa.list_(value_type))
            more = [vec] + ([pa.array(errors, pa.string())] if error_col else [])
            yield pa.RecordBatch.from_arrays(list(batch.columns) + more,
                                             names=list(batch.schema.names) + [f.name for f in fields])

    source = spread(df, id_col) if concurrent is None else at_most(df, concurrent)
    return source.mapInArrow(run, out_schema)


def _all_or_error(call, texts, retry: Retry):
    """As ``answers``, for a whole batch: no row is tried alone."""
    whole = answers(lambda one: [call(one[0])], [texts], retry)
    if whole[1][0]:
        return [None], whole[1]
    return list(whole[0][0]), [None] * len(texts)


def embed_distinct(df: DataFrame, text_col: str, embedder: Embedder | None = None, *,
                   out_col: str = "vector", dim: int | None = None) -> DataFrame:
    """Embed every distinct text once, then join the vectors back.

    Worth its two shuffles when embedding is costly (a remote model) and texts
    repeat. Rows meet their vector by the text's SHA-256, not the text, and under a salt of their own, so a
    text of many rows is spread over tasks.
    """
    salts = 8
    keyed = df.withColumn("_key", F.sha2(F.col(text_col), 256))
    uniq = (keyed.where(F.col(text_col).isNotNull()).groupBy("_key").agg(F.any_value(F.col(text_col)).alias("_t")))
    vecs = embed(uniq, "_t", embedder, out_col=out_col, dim=dim).drop("_t").withColumnRenamed("_key", "_of")
    vecs = vecs.withColumn("_of_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    own = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    at = keyed.withColumn("_salt", own)
    return (at.join(vecs, (F.col("_key") == F.col("_of")) & (F.col("_salt") == F.col("_of_salt")), "left")
            .drop("_key", "_of", "_salt", "_of_salt"))


def hashed_counts(df: DataFrame, id_col: str, text_col: str, dim: int = DEFAULT_DIM
                  ) -> DataFrame:
    """Native sparse form of the hashing embedder: ``(id, bucket, cnt, weight)``.

    The documents are hash-partitioned by id once; the per-(id, bucket) count and
    the per-id norm both reuse that partitioning, so tokens are never shuffled.
    """
    # Partitions of about NATIVE_BYTES as stored, whatever the input's size: a task aggregates all buckets of its texts.
    size = int(str(df.select(id_col, text_col)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-size // NATIVE_BYTES))
    docs = df.select(id_col, text_col)
    # A source of unknown size (no file) is estimated beyond any table: Spark's own number of partitions.
    docs = docs.repartition(n, F.col(id_col)) if size < 1 << 50 else docs.repartition(F.col(id_col))
    toks = docs.select(id_col, F.explode(tokens(text_col)).alias("_tok"))
    b = toks.select(id_col, F.pmod(F.conv(F.substring(F.md5("_tok"), 1, 8), 16, 10)
                                   .cast("bigint"), F.lit(dim)).alias("bucket"))
    cnt = b.groupBy(id_col, "bucket").agg(F.count(F.lit(1)).alias("cnt"))
    norm = F.sqrt(F.sum(F.col("cnt") * F.col("cnt")).over(Window.partitionBy(id_col)))
    return cnt.withColumn("weight", F.col("cnt") / norm)


def dense_to_sparse(df: DataFrame, id_col: str, vec_col: str = "vector") -> DataFrame:
    """``(id, bucket, weight)`` for the non-zero entries of a dense vector."""
    return (df.select(id_col, F.posexplode(vec_col).alias("bucket", "weight"))
            .where(F.col("weight") != 0))

"""Exact k-nearest-neighbour joins (J2, F11, F12, L1, W1), and cell-probed ones by ``cell_index``.

Ranking rule, everywhere: score rounded to 6 decimals (best first; for ``l2``
smallest distance first), ties broken by the corpus key ascending. Scores are
computed in float64 from the stored vectors.

Two physical plans for the exact join:

* ``broadcast`` — the corpus is counted, collected once behind a hard row bound and a bound
  on bytes as lists of its non-zero entries, shipped as a broadcast variable, and every query
  partition scores its Arrow batches against it block by block. No shuffle.
* ``blocks`` — beyond the bound. Vectors are stored as lists of their non-zero
  entries, and equal query vectors are searched once. Queries and corpus are
  dealt into groups of ``GROUP_BYTES``; each row is copied once per group of
  the other side, so that one cogroup group is one pair of groups, scored in
  tiles. It emits only its top-k per query; the final k are kept per query and
  joined back to the query rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .partitioning import spread

METRICS = ("cosine", "dot", "l2")

# Rows per query block and corpus block inside one scoring tile.
QUERY_BLOCK = 1024
CORPUS_BLOCK = 4096
# Query rows scored at a time with a corpus block (8 MB of scores).
QUERY_TILE = 256
# Bytes of the vectors of one side of a cogroup group, and its rows, at most (beyond one block).
GROUP_BYTES = 32 << 20
GROUP_ROWS = 1 << 16
# Repeats of a corpus id up to which a search without the query itself asks for as many neighbours more.
MORE_NEIGHBOURS = 16
# Default bound for the broadcast plan, in float64 bytes of the corpus matrix, and for the lists of its
# entries, which the driver holds several times over.
BROADCAST_MAX_BYTES = 256 * 1024 * 1024
LISTS_MAX_BYTES = 64 << 20
# Queries scored at a time with a broadcast corpus, at least, while there are more.
GATHERED_ROWS = 4096

_NEG = -np.inf


def _matrix(values) -> np.ndarray:
    """Stack a list-of-vectors column (pandas or Arrow) into float64 (n, dim)."""
    if isinstance(values, (pa.Array, pa.ChunkedArray)):
        arr = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
        if len(arr) == 0:
            return np.zeros((0, 0))
        if arr.null_count:
            raise ValueError("null vector in kNN input")
        flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        offsets = arr.offsets.to_numpy()
        lengths = np.diff(offsets)
        if (lengths != lengths[0]).any():
            raise ValueError(f"vectors of mixed dimension {sorted(set(lengths.tolist()))}")
        return flat.reshape(len(arr), int(lengths[0]))
    seq = list(values)
    if not seq:
        return np.zeros((0, 0))
    if any(v is None for v in seq):
        raise ValueError("null vector in kNN input")
    return np.vstack([np.asarray(v, dtype=np.float64) for v in seq])


def _products(Q: np.ndarray, C: np.ndarray) -> np.ndarray:
    """``Q @ C.T`` over the columns where the query tile has non-zeros only.

    Hashed bag-of-words queries use a few columns out of many; the skipped
    terms are exact zeros, so the products are the same sums.
    """
    used = np.flatnonzero(np.any(Q != 0.0, axis=0))
    if len(used) * 2 < Q.shape[1]:
        return Q[:, used] @ C[:, used].T
    return Q @ C.T


def _unit_rows(X: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows divided by their norm, and which have one (the others are zero rows then)."""
    n = np.sqrt(np.einsum("ij,ij->i", X, X))
    good = np.isfinite(n) & (n > 0)
    U = X / np.where(good, n, 1.0)[:, None]
    U[~good] = 0.0
    return U, good


def _select(V: np.ndarray, k: int, keys: np.ndarray):
    """Positions (qi, ci) of the k best per row of V (higher is better), key asc on ties."""
    if V.shape[1] == 0:
        return np.zeros(0, int), np.zeros(0, int)
    kk = min(k, V.shape[1])
    kth = np.partition(V, V.shape[1] - kk, axis=1)[:, V.shape[1] - kk]
    qi, ci = np.nonzero((V >= kth[:, None]) & (V > _NEG))
    if len(qi) == 0:
        return qi, ci
    order = np.lexsort((_sortable(keys[ci]), -V[qi, ci], qi))
    qi, ci = qi[order], ci[order]
    first = np.r_[0, np.flatnonzero(np.diff(qi)) + 1]
    pos = np.arange(len(qi)) - np.repeat(first, np.diff(np.r_[first, len(qi)]))
    keep = pos < k
    return qi[keep], ci[keep]


def _sortable(keys: np.ndarray) -> np.ndarray:
    """Keys usable by lexsort; strings compare by code point, as Spark does by UTF-8 bytes."""
    if keys.dtype == object:
        return np.array([str(x) for x in keys], dtype=str)
    return keys


def _value(S: np.ndarray, metric: str) -> np.ndarray:
    """Ranking value: rounded score, larger is better; undefined scores rank nowhere."""
    R = np.round(S, 6)
    V = -R if metric == "l2" else R
    return np.where(np.isnan(V), _NEG, V)


class _Lists:
    """Rows of a matrix kept as lists of their entries; ``dense`` gives some of them as a matrix."""

    def __init__(self, ix: pa.ChunkedArray, vx: pa.ChunkedArray, dim: int):
        own, values = ix.combine_chunks(), vx.combine_chunks()
        self.dim, self.values = dim, values.flatten().to_numpy(zero_copy_only=False)
        self.lens = pc.list_value_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.at = np.arange(len(self.values)) - np.repeat(self.starts, self.lens)      # rows with all entries
        listed = np.repeat(own.is_valid().to_numpy(zero_copy_only=False), self.lens)
        self.at[listed] = own.flatten().to_numpy(zero_copy_only=False)

    def __len__(self) -> int:
        return len(self.lens)

    def dense(self, rows: np.ndarray) -> np.ndarray:
        lens = self.lens[rows]
        owner = np.repeat(np.arange(len(rows)), lens)
        src = np.arange(len(owner)) + np.repeat(self.starts[rows] - (np.cumsum(lens) - lens), lens)
        out = np.zeros((len(rows), self.dim))
        out[owner, self.at[src]] = self.values[src]
        return out


def _dense(X, rows) -> np.ndarray:
    return X.dense(rows) if isinstance(X, _Lists) else X[rows]


def _topk(qids, Q, cids, ckeys, C, k, metric, exclude_self):
    """Best k per query over the whole corpus, scored tile by tile.

    The corpus is taken in the order of its keys, so a row beats what a query holds only with a better
    rounded score: after the first tile a product is compared with the query's k-th best and
    rarely anything is rounded, sorted or kept.
    Returns (query index, corpus index, score) arrays ordered by query, then rank.
    """
    order = np.argsort(_sortable(ckeys), kind="stable")
    sign = -1.0 if metric == "l2" else 1.0
    n_q = len(qids)
    least = np.full(n_q, _NEG)                   # ranking value of each query's k-th best so far
    held = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0)) for _ in range(0, n_q, QUERY_TILE)]
    for cs in range(0, len(order), CORPUS_BLOCK):
        rows = order[cs:cs + CORPUS_BLOCK]
        X, ids = _dense(C, rows), cids[rows]
        if metric == "cosine":
            X, x_good = _unit_rows(X)
        elif metric == "l2":
            xx = np.einsum("ij,ij->i", X, X)
        for t, qs in enumerate(range(0, n_q, QUERY_TILE)):
            own = np.arange(qs, min(n_q, qs + QUERY_TILE))
            Y, low = _dense(Q, own), least[own]
            if metric == "cosine":
                Y, y_good = _unit_rows(Y)
            S = _products(Y, X)
            if metric == "cosine":
                if not x_good.all():
                    S[:, ~x_good] = np.nan
                S[~y_good] = np.nan
            elif metric == "l2":
                S *= -2.0
                S += xx[None, :]
                S += np.einsum("ij,ij->i", Y, Y)[:, None]
                np.maximum(S, 0.0, out=S)
            if cs == 0:
                V = _value(np.sqrt(S) if metric == "l2" else S, metric)
                if exclude_self:
                    V[qids[own][:, None] == ids[None, :]] = _NEG
                qi, ci = _select(V, k, np.arange(len(rows)))
            else:
                # What may round above the k-th best; a margin of 0.3 of the 0.5e-6 that rounding takes.
                edge = np.where(np.abs(low) < 1e6, low + 3e-7, np.nextafter(low, _NEG))
                if metric == "l2":
                    edge = -edge
                    hit = S < np.where(edge > 0, edge * edge, 0.0)[:, None]
                else:
                    hit = S > edge[:, None]
                flat = np.flatnonzero(hit)
                qi, ci = flat // len(rows), flat % len(rows)
                if exclude_self and len(qi):
                    other = ~(qids[own][qi] == ids[ci])
                    qi, ci = qi[other], ci[other]
            if not len(qi):
                continue
            found = np.sqrt(S[qi, ci]) if metric == "l2" else S[qi, ci]
            qi, pos, sc = (np.concatenate(x) for x in zip(held[t], (qi, ci + cs, found), strict=True))
            value = _value(sc, metric)
            at = np.lexsort((pos, -value, qi))
            qi, pos, sc, value = qi[at], pos[at], sc[at], value[at]
            keep = (_ranks(qi) <= k) & (value > _NEG)
            qi, pos, sc, value = qi[keep], pos[keep], sc[keep], value[keep]
            held[t] = (qi, pos, sc)
            counts = np.bincount(qi, minlength=len(own))
            full = np.flatnonzero(counts >= k)
            least[own[full]] = value[np.cumsum(counts)[full] - 1]
    if not held:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return (np.concatenate([qi + t * QUERY_TILE for t, (qi, _, _) in enumerate(held)]),
            order[np.concatenate([pos for _, pos, _ in held])], np.concatenate([sc for _, _, sc in held]))


def _ranks(qi: np.ndarray) -> np.ndarray:
    if len(qi) == 0:
        return np.zeros(0, np.int32)
    first = np.r_[0, np.flatnonzero(np.diff(qi)) + 1]
    return (np.arange(len(qi)) - np.repeat(first, np.diff(np.r_[first, len(qi)])) + 1).astype(
        np.int32)


@dataclass(frozen=True)
class KnnSpec:
    k: int = 5
    metric: str = "cosine"
    exclude_self: bool = False


def _prepare(queries: DataFrame, query_id: str, query_vec: str, corpus: DataFrame,
             corpus_id: str, corpus_vec: str, key: str | None, carry: tuple[str, ...],
             query_carry: tuple[str, ...] = ()):
    q = queries.select(F.col(query_id).alias("_qid"), F.col(query_vec).alias("_qv"),
                       *[F.col(name).alias(f"_q{i}") for i, name in enumerate(query_carry)])
    c = corpus.select(F.col(corpus_id).alias("_cid"),
                      F.col(key or corpus_id).alias("_ck"),
                      F.col(corpus_vec).alias("_cv"),
                      *[F.col(name).alias(f"_p{i}") for i, name in enumerate(carry)])
    return q, c


def _types(df: DataFrame, cols) -> list[str]:
    return [df.schema[c].dataType.simpleString() for c in cols]


def knn_join(queries: DataFrame, corpus: DataFrame, k: int = 5, *, query_id: str = "id",
             query_vec: str = "vector", corpus_id: str = "id", corpus_vec: str = "vector",
             key: str | None = None, carry: tuple[str, ...] | list[str] = (),
             metric: str = "cosine", exclude_self: bool = False, strategy: str = "auto",
             broadcast_max_bytes: int = BROADCAST_MAX_BYTES, query_out: str = "query_id",
             corpus_out: str = "id", as_lists: bool = False,
             query_carry: tuple[str, ...] | list[str] = (), keep_empty: bool = False,
             dim: int | None = None, prepared: PreparedCorpus | None = None) -> DataFrame:
    """Exact kNN.

    Long form (default): ``(query_out, rank, corpus_out, score, *carry)``, at most
    k rows per query, ranks from 1. ``as_lists=True``: one row per query that
    has candidates, ``(query_out, <corpus_out>s, scores, <carry>s)`` as arrays in
    rank order. ``key`` is the tie-break column of the corpus (default: its id);
    ``carry`` names corpus columns returned with each neighbour;
    ``exclude_self`` drops pairs whose query id equals the corpus id.
    ``query_carry`` names query columns passed through; ``keep_empty`` (list
    form) also returns queries without any candidate, with empty arrays.
    ``prepared`` reuses a corpus already broadcast by ``prepare_corpus`` (its
    ``carry`` must match); ``corpus`` is then only used for its column types.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    if k < 1:
        raise ValueError("k must be at least 1")
    if keep_empty and not as_lists:
        raise ValueError("keep_empty needs as_lists=True")
    carry, query_carry = tuple(carry), tuple(query_carry)
    spark = queries.sparkSession
    q, c = _prepare(queries, query_id, query_vec, corpus, corpus_id, corpus_vec, key, carry,
                    query_carry)
    spec = KnnSpec(k, metric, exclude_self)
    res = lists = None
    if prepared is not None:
        if prepared.carry != carry:
            raise ValueError("prepared corpus carries different columns")
        res = _broadcast_plan(spark, q, c, spec, carry, broadcast_max_bytes, force=True,
                              as_lists=as_lists, n_qcarry=len(query_carry),
                              keep_empty=keep_empty, prepared=prepared)
    elif strategy in ("auto", "broadcast"):
        lists = _kept(c, "_cv")
        res = _broadcast_plan(spark, q, lists, spec, carry, broadcast_max_bytes,
                              force=strategy == "broadcast", as_lists=as_lists,
                              n_qcarry=len(query_carry), keep_empty=keep_empty, dim=dim)
    if res is None:
        if strategy not in ("auto", "blocks"):
            raise ValueError(f"unknown strategy {strategy!r}")
        lists = _kept(c, "_cv") if lists is None else lists
        res = _block_plan(q, lists, spec, carry, as_lists, len(query_carry), keep_empty)
    return _rename(res, carry, query_out, corpus_out, as_lists, query_carry)


def _rename(res: DataFrame, carry, query_out, corpus_out, as_lists, query_carry=()) -> DataFrame:
    qc = [F.col(f"_q{i}").alias(n) for i, n in enumerate(query_carry)]
    if as_lists:
        return res.select(F.col("_qid").alias(query_out), *qc,
                          F.col("_cid").alias(corpus_out + "s"), F.col("score").alias("scores"),
                          *[F.col(f"_p{i}").alias(n + "s") for i, n in enumerate(carry)])
    return res.select(F.col("_qid").alias(query_out), *qc, "rank",
                      F.col("_cid").alias(corpus_out), "score",
                      *[F.col(f"_p{i}").alias(n) for i, n in enumerate(carry)])


def _qcols(q, n_qcarry) -> str:
    names = ["_qid"] + [f"_q{i}" for i in range(n_qcarry)]
    return ", ".join(f"{n} {t}" for n, t in zip(names, _types(q, names)))


def _long_schema(q, c, carry, n_qcarry=0) -> str:
    cols = ["_cid", "_ck"] + [f"_p{i}" for i in range(len(carry))]
    types = _types(c, cols)
    body = ", ".join(f"{n} {t}" for n, t in zip(cols, types))
    return f"{_qcols(q, n_qcarry)}, rank int, {body}, score double"


def _list_schema(q, c, carry, n_qcarry=0) -> str:
    cols = ["_cid"] + [f"_p{i}" for i in range(len(carry))]
    types = _types(c, cols)
    body = ", ".join(f"{n} array<{t}>" for n, t in zip(cols, types))
    return f"{_qcols(q, n_qcarry)}, {body}, score array<double>"


def _arrow_take(col, idx: np.ndarray):
    return col.take(pa.array(idx, pa.int64()))


def _emit(batch, qids, cids, ckeys, carried, qi, ci, sc, as_lists: bool, n_qcarry: int,
          keep_empty: bool) -> pa.RecordBatch:
    """Arrow batch of results from (query index, corpus index, score) arrays in rank order."""
    qextra = [batch.column(f"_q{i}") for i in range(n_qcarry)]
    if not as_lists:
        cols = {"_qid": pa.array(qids[qi])}
        cols.update({f"_q{i}": _arrow_take(col, qi) for i, col in enumerate(qextra)})
        cols.update({"rank": pa.array(_ranks(qi)), "_cid": pa.array(cids[ci]),
                     "_ck": pa.array(ckeys[ci])})
        cols.update({f"_p{i}": pa.array(arr[ci]) for i, arr in enumerate(carried)})
        cols["score"] = pa.array(sc, pa.float64())
        return pa.RecordBatch.from_pydict(cols)
    counts = np.bincount(qi, minlength=len(qids))
    rows = np.arange(len(qids)) if keep_empty else np.flatnonzero(counts)
    offsets = pa.array(np.r_[0, np.cumsum(counts[rows])].astype(np.int32))
    cols = {"_qid": pa.array(qids[rows])}
    cols.update({f"_q{i}": _arrow_take(col, rows) for i, col in enumerate(qextra)})
    cols["_cid"] = pa.ListArray.from_arrays(offsets, pa.array(cids[ci]))
    for i, arr in enumerate(carried):
        cols[f"_p{i}"] = pa.ListArray.from_arrays(offsets, pa.array(arr[ci]))
    cols["score"] = pa.ListArray.from_arrays(offsets, pa.array(sc, pa.float64()))
    return pa.RecordBatch.from_pydict(cols)


@dataclass
class PreparedCorpus:
    """A corpus collected once and broadcast, reusable by many ``knn_join`` calls
    (e.g. every micro-batch of a stream). ``types`` are the Spark types of the
    id, key and carried columns; ``carry`` the carried column names."""
    bc: object
    types: dict
    carry: tuple
    dim: int
    rows: int

    def release(self) -> None:
        self.bc.unpersist()


def prepare_corpus(corpus: DataFrame, *, corpus_id: str = "id", corpus_vec: str = "vector",
                   key: str | None = None, carry=(), dim: int | None = None,
                   broadcast_max_bytes: int = BROADCAST_MAX_BYTES) -> PreparedCorpus | None:
    """Collect a corpus behind a hard row bound and broadcast it; None if too large."""
    c = corpus.select(F.col(corpus_id).alias("_cid"), F.col(key or corpus_id).alias("_ck"),
                      F.col(corpus_vec).alias("_cv"),
                      *[F.col(n).alias(f"_p{i}") for i, n in enumerate(carry)])
    return _collect_corpus(corpus.sparkSession, _kept(c, "_cv"), tuple(carry), broadcast_max_bytes,
                           force=False, dim=dim)


def _collect_corpus(spark, c: DataFrame, carry, max_bytes: int, force: bool,
                    dim: int | None) -> PreparedCorpus | None:
    """``c`` (from ``_kept``) is counted and measured before any row of it is collected, and collected as lists of entries."""
    n, row_bytes, dims = _measured(c)
    if dim is None:
        dim = max(dims, default=1)
    max_rows = max(1, max_bytes // (8 * max(dim, 1) + 64))
    if n > max_rows and force:
        raise ValueError(f"corpus larger than the broadcast bound of {max_rows} rows")
    if n > max_rows or (n * row_bytes > LISTS_MAX_BYTES and not force):
        return None
    if len(dims) > 1:
        raise ValueError(f"vectors of mixed dimension {sorted(dims)}")
    tbl = c.drop("_dim").toArrow()
    cids = tbl.column("_cid").to_numpy(zero_copy_only=False)
    ckeys = tbl.column("_ck").to_numpy(zero_copy_only=False)
    carried = [tbl.column(f"_p{i}").to_numpy(zero_copy_only=False) for i in range(len(carry))]
    C = _Lists(tbl.column("_ix"), tbl.column("_vx"), max(dims)) if tbl.num_rows else None
    names = ["_cid", "_ck"] + [f"_p{i}" for i in range(len(carry))]
    types = dict(zip(names, _types(c, names)))
    return PreparedCorpus(spark.sparkContext.broadcast((cids, ckeys, carried, C)), types,
                          tuple(carry), dim, tbl.num_rows)


def _gathered(batches, rows: int = GATHERED_ROWS):
    """Batches joined to ``rows`` rows at least, but for the last."""
    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _broadcast_plan(spark, q: DataFrame, c: DataFrame, spec: KnnSpec, carry, max_bytes: int,
                    force: bool, as_lists: bool, n_qcarry: int = 0,
                    keep_empty: bool = False, dim: int | None = None,
                    prepared: PreparedCorpus | None = None) -> DataFrame | None:
    """Score against a broadcast corpus (``c`` from ``_kept``); None if the corpus exceeds the bounds.

    The bound is in rows for the vector dimension (given, or measured).
    """
    if prepared is None:
        prepared = _collect_corpus(spark, c, carry, max_bytes, force, dim)
        if prepared is None:
            return None
    bc = prepared.bc
    t = prepared.types
    qcols = _qcols(q, n_qcarry)
    if as_lists:
        body = ", ".join(f"{n} array<{t[n]}>" for n in ["_cid"] + [f"_p{i}" for i in
                                                                  range(len(carry))])
        schema = f"{qcols}, {body}, score array<double>"
    else:
        body = ", ".join(f"{n} {t[n]}" for n in ["_cid", "_ck"] + [f"_p{i}" for i in
                                                                 range(len(carry))])
        schema = f"{qcols}, rank int, {body}, score double"
    k, metric, exclude_self = spec.k, spec.metric, spec.exclude_self

    def score_batches(batches):
        bcids, bckeys, bcarried, BC = bc.value
        for batch in _gathered(batches):
            qids = batch.column("_qid").to_numpy(zero_copy_only=False)
            if len(bcids):
                qi, ci, sc = _topk(qids, _matrix(batch.column("_qv")), bcids, bckeys, BC, k,
                                   metric, exclude_self)
            else:
                qi, ci, sc = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
            if len(qi) or keep_empty:
                yield _emit(batch, qids, bcids, bckeys, bcarried, qi, ci, sc, as_lists,
                            n_qcarry, keep_empty)

    out = spread(q, "_qid").mapInArrow(score_batches, schema)
    return out if as_lists else out.drop("_ck")


def _compact(df: DataFrame, vec: str) -> DataFrame:
    """``vec`` as the lists ``_ix`` (places of its entries; null: all places) and ``_vx``, with its dimension ``_dim``."""
    names = [n for n in df.columns if n != vec]

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, QUERY_BLOCK):
                batch = whole.slice(start, QUERY_BLOCK)
                X = _matrix(batch.column(vec))
                row, col = np.nonzero(X)
                sparse = 2 * len(row) < X.size
                ends = np.searchsorted(row, np.arange(len(X) + 1)) if sparse else np.arange(len(X) + 1) * X.shape[1]
                ends = pa.array(ends.astype(np.int32))
                ix = pa.ListArray.from_arrays(ends, pa.array(col.astype(np.int32))) if sparse else pa.nulls(len(X), pa.list_(pa.int32()))
                vx = pa.ListArray.from_arrays(ends, pa.array(X[row, col] if sparse else X.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], ix, vx, pa.array(np.full(len(X), X.shape[1], np.int32))],
                                                 names=[*names, "_ix", "_vx", "_dim"])

    body = "".join(f"{n} {t}, " for n, t in zip(names, _types(df, names), strict=True))
    return df.mapInArrow(run, f"{body}_ix array<int>, _vx array<double>, _dim int")


def _kept(df: DataFrame, vec: str) -> DataFrame:
    """``_compact``, checkpointed."""
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return _compact(df, vec).checkpoint()


def _measured(df: DataFrame) -> tuple[int, float, set]:
    """Rows, mean bytes of a vector's lists, and dimensions."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("_vx") * 12 + 64).alias("bytes"), F.min("_dim").alias("a"), F.max("_dim").alias("b")).first()
    return r["n"], r["bytes"] or 64.0, {r["a"], r["b"]} - {None}


def _group_rows(row_bytes: float, least: int) -> int:
    return max(least, min(GROUP_ROWS, int(GROUP_BYTES / row_bytes)))


def _block_plan(q: DataFrame, c: DataFrame, spec: KnnSpec, carry, as_lists: bool, n_qcarry: int = 0, keep_empty: bool = False) -> DataFrame:
    """Both sides are stored as lists of non-zero entries (``c`` is from ``_kept``); equal query vectors are searched once. Each side is copied
    once per group of the other, and groups are as large as a task's memory allows."""
    spark = q.sparkSession
    q = _kept(q, "_qv")
    n_c, c_bytes, c_dims = _measured(c)
    k, mine, self_in_tile = spec.k, ["_ix", "_vx"], False
    if spec.exclude_self:
        # A query's own rows, as often as its id is in the corpus, are left out of a longer list.
        most = c.groupBy("_cid").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        self_in_tile = most > MORE_NEIGHBOURS
        k, mine = (k, ["_qid", *mine]) if self_in_tile else (k + most, mine)
    asked = q.select(*mine, "_dim").distinct().withColumn("_gid", F.monotonically_increasing_id()).checkpoint()
    n_q, q_bytes, q_dims = _measured(asked)
    if len(q_dims | c_dims) > 1:
        raise ValueError(f"vectors of mixed dimension {sorted(q_dims | c_dims)}")
    dim = max(q_dims | c_dims, default=1)
    n_qb = max(1, math.ceil(n_q / _group_rows(q_bytes, QUERY_BLOCK)))
    spare = math.ceil(2 * spark.sparkContext.defaultParallelism / n_qb)         # groups enough for every core
    n_cb = max(1, math.ceil(n_c / _group_rows(c_bytes, CORPUS_BLOCK)), min(spare, math.ceil(n_c / CORPUS_BLOCK)))
    qr = (asked.drop("_dim").withColumn("_qb", F.pmod(F.xxhash64("_gid"), F.lit(n_qb)).cast("int"))
          .withColumn("_cb", F.explode(F.sequence(F.lit(0), F.lit(n_cb - 1)))))
    cr = (c.drop("_dim").withColumn("_cb", F.pmod(F.monotonically_increasing_id(), F.lit(n_cb)).cast("int"))
          .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(n_qb - 1)))))
    names, metric = ["_cid", "_ck"] + [f"_p{i}" for i in range(len(carry))], spec.metric
    schema = "_gid long, " + ", ".join(f"{n} {t}" for n, t in zip(names, _types(c, names), strict=True)) + ", score double"

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        gids = left.column("_gid").to_numpy()
        if not left.num_rows or not right.num_rows:
            qi, ci, sc = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        else:
            qids = left.column("_qid").to_numpy() if self_in_tile else gids
            qi, ci, sc = _topk(qids, _Lists(left.column("_ix"), left.column("_vx"), dim), right.column("_cid").to_numpy(), right.column("_ck").to_numpy(),
                               _Lists(right.column("_ix"), right.column("_vx"), dim), k, metric, self_in_tile)
        return pa.table([pa.array(gids[qi]), *[right.column(n).take(pa.array(ci, pa.int64())) for n in names], pa.array(sc, pa.float64())],
                        names=["_gid", *names, "score"])

    partial = qr.groupBy("_qb", "_cb").cogroup(cr.groupBy("_qb", "_cb")).applyInArrow(tile, schema)
    r = F.round("score", 6)
    fields = [(r if metric == "l2" else -r).alias("v"), F.col("_ck").alias("ck"), *[F.col(n) for n in names], F.col("score")]
    lists = (partial.groupBy("_gid").agg(F.slice(F.array_sort(F.collect_list(F.struct(*fields))), 1, k).alias("_b"))
             .join(asked.drop("_dim"), "_gid").drop("_gid"))
    for name in mine:
        lists = lists.withColumnRenamed(name, f"_of{name}")
    same = [F.col(name).eqNullSafe(F.col(f"_of{name}")) for name in mine]
    found = q.join(lists, same, "left" if keep_empty else "inner")
    best = F.col("_b")
    if spec.exclude_self and not self_in_tile:
        text = q.schema["_qid"].dataType.simpleString() == "string"
        own = (lambda x: x["_cid"].eqNullSafe(F.col("_qid"))) if text else (lambda x: F.coalesce(x["_cid"] == F.col("_qid"), F.lit(False)))
        best = F.slice(F.filter(best, lambda x: ~own(x)), 1, spec.k)
    found = found.select("_qid", *[f"_q{i}" for i in range(n_qcarry)], best.alias("_b"))
    if as_lists:
        if not keep_empty:
            found = found.where(F.size("_b") > 0)
        kept = F.coalesce("_b", F.array().cast(found.schema["_b"].dataType))
        found = found.withColumn("_b", kept)
        return found.select("_qid", *[f"_q{i}" for i in range(n_qcarry)], F.col("_b._cid").alias("_cid"),
                            *[F.col(f"_b.{n}").alias(n) for n in names[2:]], F.col("_b.score").alias("score"))
    flat = found.select("_qid", *[f"_q{i}" for i in range(n_qcarry)], F.inline("_b")).drop("v", "ck")
    return rank_candidates(flat, "_qid", "_ck", spec.k, metric).drop("_ck")


def _merge(partial: DataFrame, spec: KnnSpec, carry, as_lists: bool) -> DataFrame:
    """Final k per query from per-cell candidates (one shuffle on the query id)."""
    if not as_lists:
        return rank_candidates(partial, "_qid", "_ck", spec.k, spec.metric).drop("_ck")
    r = F.round("score", 6)
    fields = [(r if spec.metric == "l2" else -r).alias("v"), F.col("_ck").alias("ck"),
              F.col("_cid").alias("cid"), *[F.col(f"_p{i}") for i in range(len(carry))],
              F.col("score")]
    best = F.slice(F.array_sort(F.collect_list(F.struct(*fields))), 1, spec.k)
    g = partial.groupBy("_qid").agg(best.alias("_b"))
    return g.select("_qid", F.col("_b.cid").alias("_cid"),
                    *[F.col(f"_b._p{i}").alias(f"_p{i}") for i in range(len(carry))],
                    F.col("_b.score").alias("score"))


def rank_candidates(cands: DataFrame, query_col: str, key_col: str, k: int,
                    metric: str = "cosine", score_col: str = "score") -> DataFrame:
    """W1 + L1: ``row_number`` per query by rounded score then key; keep k."""
    r = F.round(F.col(score_col), 6)
    order = [r.asc_nulls_last() if metric == "l2" else r.desc_nulls_last(), F.col(key_col).asc()]
    w = Window.partitionBy(query_col).orderBy(*order)
    return cands.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# --------------------------------------------------------------------------- J3


def knn_cells(queries: DataFrame, corpus: DataFrame, k: int = 5, *, n_cells: int | None = None,
              nprobe: int | None = None, seed: int = 42, query_id: str = "id",
              query_vec: str = "vector", corpus_id: str = "id", corpus_vec: str = "vector",
              key: str | None = None, carry: tuple[str, ...] | list[str] = (),
              metric: str = "cosine", exclude_self: bool = False, query_out: str = "query_id",
              corpus_out: str = "id", as_lists: bool = False,
              max_centroid_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Approximate kNN by k-means cells; same output as ``knn_join``.

    Builds a cell index for this one search (``cell_index``, which also keeps
    one for many searches). ``nprobe`` defaults to what the index needs for a
    recall of 0.9; ``nprobe >= n_cells`` is exact search.
    """
    from ..session import work_dir
    from .cell_index import build_index, search

    index = build_index(corpus, work_dir(queries.sparkSession, "cells"), corpus_id=corpus_id,
                        corpus_vec=corpus_vec, key=key, carry=carry, metric=metric,
                        n_cells=n_cells, seed=seed, nprobe=nprobe, k=k,
                        max_centroid_bytes=max_centroid_bytes)
    return search(index, queries, k, query_id=query_id, query_vec=query_vec,
                  exclude_self=exclude_self, query_out=query_out, corpus_out=corpus_out,
                  as_lists=as_lists)


def recall_at_k(approx: DataFrame, exact: DataFrame, query_col: str = "query_id",
                id_col: str = "id") -> DataFrame:
    """Share of exact neighbours the approximate search also returned."""
    found = approx.select(query_col, id_col).withColumn("_found", F.lit(1))
    flagged = exact.select(query_col, id_col).join(found, [query_col, id_col], "left")
    return (flagged.agg(F.count(F.lit(1)).alias("n_exact"),
                        F.count("_found").alias("n_found"))
            .select("n_exact", "n_found",
                    F.round(F.col("n_found") / F.col("n_exact"), 6).alias("recall")))

"""A stored cell index over vectors: built once, probed many times (J3), and exact search with bounds.

Layout under the index folder::

    vectors/cell=<c>/   rows of one cell: id, key, vector, carried columns, sub-block
    cells/              one row per cell: centre, radius, least and largest norm, rows
    rejects/            rows that can't be indexed, with the reason (null, wrong dimension, no direction)
    meta/               one JSON row: dimension, metric, carried columns, calibrated number of probes

Build: k-means centres (Spark ML) are fitted on the ``sample_rows`` rows with the smallest id hash, a documented bound; every row
is then assigned to its nearest centre and written. A cell larger than one scoring tile is split into sub-blocks by
id hash. How many cells a search probes is calibrated: for ``CALIBRATE`` indexed vectors the true neighbours are found by
searching all cells, and the fewest probes that reach ``target`` recall (plus a margin) are stored with the index. Vectors without
clusters need many probes; clustered ones few.

Search reads the probed cells only (``cell`` is a partition column). Queries below a checked number of bytes are broadcast, and the
cells are scored where they are read, so the corpus is not shuffled; a task keeps the best ``k`` per query. Beyond that,
the sub-blocks of cells are dealt into groups of bounded bytes and the queries of a group into blocks, and both are cogrouped, so neither a
hot cell nor a cell that all queries probe is one task, and a vector is copied once per group or block of the other side, not once per cell.

Exact search drops cells by bounds. A first probe of the nearest cells gives each query a k-th best value; a cell whose
best possible value (centre, radius and norms bound it) is below can't hold a neighbour, and its pair with the query is dropped
before anything is shuffled or scored. ``search_report`` counts the pairs that were scored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from .knn import (BROADCAST_MAX_BYTES, CORPUS_BLOCK, GROUP_BYTES, GROUP_ROWS, METRICS, QUERY_BLOCK, QUERY_TILE, KnnSpec, _matrix, _merge, _products,
                  _ranks, _rename, _select, _sortable, _topk, _types, _unit_rows, _value)
from .partitioning import spread

SAMPLE_ROWS = 1 << 16
CALIBRATE = 256
MARGIN = 0.03
#: Queries that are broadcast, in bytes of their vectors and probes.
QUERIES_MAX_BYTES = 64 << 20
#: Rounding of scores: a value this much below the k-th best may still tie with it.
_SLACK = 2e-6
_META = "dim int, metric string, carry array<string>, nprobe int, rows bigint"


@dataclass(frozen=True)
class CellIndex:
    """An opened index: what is known of its cells, and where the vectors are."""
    path: str
    dim: int
    metric: str
    carry: tuple
    nprobe: int
    rows: int
    centres: np.ndarray = field(repr=False)
    radius: np.ndarray = field(repr=False)
    norms: tuple = field(repr=False)
    sizes: np.ndarray = field(repr=False)

    @property
    def n_cells(self) -> int:
        return len(self.sizes)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.where(n > 0, n, 1)[:, None]


def _nearness(q: np.ndarray, centres: np.ndarray, metric: str) -> np.ndarray:
    """How near each cell is to each query, larger is nearer: cosine, or the distance below zero."""
    if metric == "l2":
        d = np.einsum("ij,ij->i", q, q)[:, None] + np.einsum("ij,ij->i", centres, centres)[None] - 2 * q @ centres.T
        return -np.sqrt(np.maximum(d, 0))
    return np.clip(_unit(q) @ _unit(centres).T, -1, 1)


def _best_possible(q: np.ndarray, index: CellIndex) -> np.ndarray:
    """Upper bound of the ranking value of any row of a cell, for each query and cell."""
    near = _nearness(q, index.centres, index.metric)
    if index.metric == "l2":
        return -np.maximum(0, -near - index.radius[None])
    cosine = np.cos(np.maximum(0, np.arccos(near) - index.radius[None]))
    if index.metric == "cosine":
        return cosine
    least, most = index.norms
    size = np.sqrt(np.einsum("ij,ij->i", q, q))[:, None]
    return size * cosine * np.where(cosine >= 0, most[None], least[None])


def _usable(col: pa.Array, dim: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that have a vector of the dimension and, for cosine, a direction; their matrix; why not, for every row)."""
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    lens = pc.fill_null(pc.list_value_length(arr), -1).to_numpy(zero_copy_only=False)
    why = np.where(lens < 0, "null vector", np.where(lens != dim, "wrong dimension", "")).astype(object)
    at = np.flatnonzero(lens == dim)
    flat = arr.take(pa.array(at)).flatten()
    x = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False).reshape(len(at), dim) if len(at) else np.zeros((0, dim))
    bad = ~np.isfinite(x).all(axis=1)
    why[at[bad]] = "value missing"
    if metric != "l2":
        zero = ~bad & ~x.any(axis=1)
        # A zero vector has no cosine at all; its dot products are all 0, and any cell will do.
        if metric == "cosine":
            why[at[zero]] = "no direction"
            bad |= zero
    return at[~bad], x[~bad], why


def build_index(corpus: DataFrame, path: str, *, corpus_id: str = "id", corpus_vec: str = "vector", key: str | None = None,
                carry: tuple[str, ...] | list[str] = (), metric: str = "cosine", n_cells: int | None = None, seed: int = 42,
                sample_rows: int = SAMPLE_ROWS, target: float = 0.9, k: int = 5, max_centroid_bytes: int = BROADCAST_MAX_BYTES,
                nprobe: int | None = None) -> CellIndex:
    """Write the index of ``corpus`` to ``path`` (replacing what is there) and open it; ``nprobe`` skips the calibration."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    spark, carry = corpus.sparkSession, tuple(carry)
    ensure_checkpoint_dir(spark)
    c = corpus.select(F.col(corpus_id).alias("_cid"), F.col(key or corpus_id).alias("_ck"), F.col(corpus_vec).alias("_cv"),
                      *[F.col(n).alias(f"_p{i}") for i, n in enumerate(carry)])
    first = c.select(F.size("_cv").alias("d")).where(F.col("_cv").isNotNull() & (F.size("_cv") > 0)).first()
    dim = int(first["d"]) if first else 1
    fit_on = (c.where((F.size("_cv") == dim) & ~F.exists("_cv", lambda x: x.isNull() | F.isnan(x)) & F.exists("_cv", lambda x: x != 0))
              .orderBy(F.xxhash64("_cid"), "_cid").limit(sample_rows).select("_cv").checkpoint())
    n_sample = fit_on.count()
    if n_cells is None:
        n_cells = int(math.sqrt(c.count()))
    n_cells = max(1, min(n_cells, n_sample, max_centroid_bytes // (8 * dim)))
    if n_cells > 1:
        feats = fit_on.select(array_to_vector(F.col("_cv").cast("array<double>")).alias("features"))
        model = KMeans(k=n_cells, seed=seed, maxIter=20, distanceMeasure="euclidean" if metric == "l2" else "cosine").fit(feats)
        centres = np.vstack(model.clusterCenters())
    else:
        one = fit_on.first()
        centres = np.array([one["_cv"]], dtype=np.float64) if one else np.zeros((1, dim))
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches):
        cen = shared.value
        for batch in batches:
            at, x, why = _usable(batch.column("_cv"), dim, metric)
            cell, apart, norm = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            if len(at):
                near = _nearness(x, cen, metric)
                cell[at] = near.argmax(axis=1)
                best = near.max(axis=1)
                apart[at] = -best if metric == "l2" else np.arccos(best)
                norm[at] = np.sqrt(np.einsum("ij,ij->i", x, x))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(apart), pa.array(norm), pa.array(why, pa.string())],
                                             names=[*batch.schema.names, "cell", "apart", "norm", "why"])

    body = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in c.schema.fields)
    assigned = spread(c, "_cid").mapInArrow(assign, f"{body}, cell int, apart double, norm double, why string").checkpoint()
    assigned.where("cell < 0").select(*c.columns, "why").write.mode("overwrite").parquet(f"{path}/rejects")
    good = assigned.where("cell >= 0")
    cells = good.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.max("apart").alias("radius"), F.min("norm").alias("least"),
                                     F.max("norm").alias("most"))
    listed = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(centres)], "cell int, centre array<double>")
    (listed.join(cells, "cell", "left").fillna(0, ["rows"]).fillna(0.0, ["radius", "least", "most"]).coalesce(1)
     .write.mode("overwrite").parquet(f"{path}/cells"))
    subs = cells.select("cell", F.ceil(F.col("rows") / CORPUS_BLOCK).cast("int").alias("subs"))
    (good.join(F.broadcast(subs), "cell")                                   # a row per cell
     .withColumn("sub", F.pmod(F.xxhash64("_cid"), F.col("subs")).cast("int")).drop("subs", "apart", "norm", "why")
     .repartition("cell", "sub").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors"))
    rows = good.count()

    def write_meta(probes: int) -> None:
        spark.createDataFrame([(dim, metric, list(carry), probes, rows)], _META).coalesce(1).write.mode("overwrite").json(f"{path}/meta")

    write_meta(nprobe or n_cells)
    if nprobe is None and rows:
        write_meta(_calibrated(spark, open_index(spark, path), target, k))
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> CellIndex:
    meta = spark.read.schema(_META).json(f"{path}/meta").first()
    if meta is None:
        raise FileNotFoundError(f"no cell index at {path}")
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").toPandas()              # bounded by the centroids' bytes
    return CellIndex(path, meta["dim"], meta["metric"], tuple(meta["carry"] or ()), meta["nprobe"], meta["rows"], np.vstack(cells["centre"].to_numpy()),
                     cells["radius"].to_numpy(), (cells["least"].to_numpy(), cells["most"].to_numpy()), cells["rows"].to_numpy())


def _calibrated(spark: SparkSession, index: CellIndex, target: float, k: int) -> int:
    """The fewest probes that find ``target`` (and a margin) of the true neighbours of ``CALIBRATE`` indexed vectors."""
    some = (_vectors(spark, index).orderBy(F.xxhash64("_cid"), "_cid").limit(CALIBRATE).select(F.col("_cid").alias("_qid"), F.col("_cv").alias("_qv"))
            .checkpoint())
    asked = _ask(some, index, lambda q: np.ones((len(q), index.n_cells), bool)).checkpoint()
    found = _merge_cells(_scan(spark, asked, index, KnnSpec(k, index.metric, True)), KnnSpec(k, index.metric, True))
    found = found.groupBy("_qid").agg(F.collect_list("cell").alias("cells")).join(some, "_qid").collect()         # CALIBRATE rows
    if not found:
        return index.n_cells
    q = np.array([r["_qv"] for r in found], dtype=np.float64)
    order = np.argsort(-_nearness(q, index.centres, index.metric), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(index.n_cells)[None].repeat(len(q), 0), 1)
    ranks = np.sort(np.concatenate([place[i, r["cells"]] for i, r in enumerate(found)]))
    wanted = min(len(ranks), math.ceil(min(1.0, target + MARGIN) * len(ranks)))
    return int(ranks[wanted - 1]) + 1


def _vectors(spark: SparkSession, index: CellIndex) -> DataFrame:
    return spark.read.parquet(f"{index.path}/vectors") if index.rows else spark.createDataFrame([], "_cid string, _ck string, _cv array<double>, "
                                                                                                     "sub int, cell int")


def _ask(queries: DataFrame, index: CellIndex, wanted) -> DataFrame:
    """(_qid, _qv, cells) of the queries that can be scored; ``wanted`` gives the cells of a matrix of queries as booleans."""
    shared = queries.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        own = shared.value
        for batch in batches:
            at, q, _ = _usable(batch.column("_qv"), own.dim, own.metric)
            if not len(at):
                continue
            extra = [batch.column(n).take(pa.array(at)).to_numpy(zero_copy_only=False) for n in batch.schema.names[2:]]
            mask = wanted(q, *extra) & (own.sizes > 0)[None]
            which, cell = np.nonzero(mask)
            ends = np.searchsorted(which, np.arange(len(at) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(cell.astype(np.int32)))
            keep = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column("_qid").take(keep), batch.column("_qv").take(keep), lists], names=["_qid", "_qv", "cells"])

    qid, qv = _types(queries, ["_qid", "_qv"])
    return queries.mapInArrow(run, f"_qid {qid}, _qv {qv}, cells array<int>")


def _nearest(index: CellIndex, n: int):
    """The ``n`` nearest cells of each query, of those that have rows."""
    def wanted(q, *_):
        near = np.where(index.sizes[None] > 0, _nearness(q, index.centres, index.metric), -np.inf)
        order = np.argsort(-near, axis=1, kind="stable")[:, :n]
        mask = np.zeros(near.shape, bool)
        np.put_along_axis(mask, order, True, 1)
        return mask
    return wanted


def _scan(spark: SparkSession, asked: DataFrame, index: CellIndex, spec: KnnSpec, max_bytes: int = QUERIES_MAX_BYTES,
          strategy: str = "auto") -> DataFrame:
    """Candidates (_qid, _cid, _ck, _p.., cell, score): the best of the cells that each query asks for. ``asked`` is read several times
    (for its size, its blocks, and to be scored), so it should be checkpointed."""
    if strategy not in ("auto", "broadcast", "blocks"):
        raise ValueError(f"unknown strategy {strategy!r}")
    if strategy != "blocks":
        most = max(1, max_bytes // (8 * index.dim + 4 * index.n_cells + 64))
        table = asked.limit(most + 1).toArrow()
        if table.num_rows <= most or strategy == "broadcast":
            return _scan_broadcast(spark, table, asked, index, spec)
    return _scan_blocks(spark, asked, index, spec)


def _columns(v: DataFrame) -> list[str]:
    return ["_cid", "_ck", *sorted((c for c in v.columns if c.startswith("_p")), key=lambda c: int(c[2:]))]


def _candidate_schema(asked: DataFrame, v: DataFrame) -> str:
    names = _columns(v)
    body = ", ".join(f"{n} {t}" for n, t in zip(names, _types(v, names), strict=True))
    return f"_qid {_types(asked, ['_qid'])[0]}, {body}, cell int, score double"


def _scan_broadcast(spark: SparkSession, table: pa.Table, asked: DataFrame, index: CellIndex, spec: KnnSpec) -> DataFrame:
    qids = table.column("_qid").to_numpy(zero_copy_only=False)
    q = _matrix(table.column("_qv")) if table.num_rows else np.zeros((0, index.dim))
    lists = table.column("cells").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int32()))
    cell = lists.flatten().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(table.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False)) if table.num_rows else cell
    order = np.argsort(cell, kind="stable")
    cells, starts = np.unique(cell[order], return_index=True)
    by_cell = dict(zip(cells.tolist(), np.split(owner[order], starts[1:]), strict=True)) if len(cells) else {}
    v = _vectors(spark, index)
    names = _columns(v)
    if len(by_cell) < index.n_cells:                    # partition pruning: other cells are not read
        v = v.where(F.col("cell").isin([int(x) for x in by_cell]) if by_cell else F.lit(False))
    shared = spark.sparkContext.broadcast((qids, q, by_cell))
    schema = T._parse_datatype_string(_candidate_schema(asked, _vectors(spark, index)))
    k, metric, exclude_self = spec.k, spec.metric, spec.exclude_self

    def best(parts):
        """The best k of each query among candidate arrays (query, value, key, columns.., cell, score)."""
        joined = [np.concatenate(x) for x in zip(*parts, strict=True)]
        at = np.lexsort((_sortable(joined[2]), -joined[1], joined[0]))
        qi = joined[0][at]
        first = np.r_[0, np.flatnonzero(np.diff(qi)) + 1]
        place = np.arange(len(qi)) - np.repeat(first, np.diff(np.r_[first, len(qi)]))
        return [x[at[place < k]] for x in joined]

    def run(batches):
        ids, queries, wanted = shared.value
        held, size = [], 0
        for batch in batches:
            cells_here = batch.column("cell").to_numpy()
            for c in np.unique(cells_here).tolist():
                if c not in wanted:
                    continue
                rows = pa.array(np.flatnonzero(cells_here == c))
                cols = [batch.column(n).take(rows).to_numpy(zero_copy_only=False) for n in names]
                which = wanted[c]
                qi, ci, score = _topk(ids[which], queries[which], cols[0], cols[1], _matrix(batch.column("_cv").take(rows)), k, metric, exclude_self)
                held.append([which[qi], _value(score, metric), cols[1][ci], *[x[ci] for x in cols], np.full(len(qi), c, np.int32), score])
                size += len(qi)
                if size > 4 * k * len(ids) + 100_000:
                    held = [best(held)]
                    size = len(held[0][0])
        if size:
            qi, _, _, *cols, cell_of, score = best(held)
            yield pa.RecordBatch.from_arrays([pa.array(ids[qi]), *[pa.array(x) for x in cols], pa.array(cell_of), pa.array(score)],
                                             names=["_qid", *names, "cell", "score"])

    return v.select(*names, "_cv", "cell").mapInArrow(run, schema)


def _packed(sizes: np.ndarray, asked: np.ndarray, dim: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Sub-blocks of the asked cells dealt into groups of bounded rows and bytes, in the order of cells: ((cell, sub, group)..,
    (first and last cell) of each group)."""
    most = max(CORPUS_BLOCK, min(GROUP_ROWS, GROUP_BYTES // (8 * dim + 64)))
    units, spans, held = [], [], 0.0
    for cell in np.flatnonzero((asked > 0) & (sizes > 0)).tolist():
        subs = max(1, math.ceil(sizes[cell] / CORPUS_BLOCK))
        for sub in range(subs):
            rows = sizes[cell] / subs
            if not spans or held + rows > most:
                spans.append((cell, cell))
                held = 0.0
            held += rows
            spans[-1] = (spans[-1][0], cell)
            units.append((cell, sub, len(spans) - 1))
    return units, spans


def _topk_of_cells(qids, Q, asks, cids, ckeys, C, cell, k, metric, exclude_self):
    """As ``_topk``, of the rows of those cells that each query asks for (``asks``: queries by cells, ``cell``: column of each row).

    A query holds its best k over all cells, so after its first cell a product is only compared with the k-th best. Cells don't follow
    the order of keys, so what may round to the k-th best value is kept until it is ranked by its key.
    """
    order = np.argsort(cell, kind="stable")
    C, cids = C[order], cids[order]
    place = np.empty(len(order), np.int64)
    place[np.argsort(_sortable(ckeys[order]), kind="stable")] = np.arange(len(order))
    if metric == "cosine":
        (C, _), (Q, _) = _unit_rows(C), _unit_rows(Q)
    else:
        xx, yy = np.einsum("ij,ij->i", C, C), np.einsum("ij,ij->i", Q, Q)
    here, starts = np.unique(cell[order], return_index=True)
    tiles = [(c, s, min(end, s + CORPUS_BLOCK)) for c, start, end in zip(here, starts, np.r_[starts[1:], len(order)], strict=True)
             for s in range(start, end, CORPUS_BLOCK)]
    out = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    for qs in range(0, len(qids), QUERY_TILE):
        own = slice(qs, qs + QUERY_TILE)
        wants, ids = asks[own], qids[own]
        low = np.full(len(ids), -np.inf)
        held = (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        for c, s, e in tiles:
            which = np.flatnonzero(wants[:, c])
            if not len(which):
                continue
            S = _products(Q[own][which], C[s:e])
            if metric == "l2":
                S = np.maximum(xx[None, s:e] + yy[own][which][:, None] - 2 * S, 0.0)
            bound = low[which]
            if np.isneginf(bound).any():
                V = _value(np.sqrt(S) if metric == "l2" else S, metric)
                if exclude_self:
                    V[ids[which][:, None] == cids[None, s:e]] = -np.inf
                qi, ci = _select(V, k, place[s:e])
            else:
                edge = bound - 7e-7
                qi, ci = np.nonzero(S <= (edge * edge * (1 + 1e-12))[:, None] if metric == "l2" else S >= edge[:, None])
                if exclude_self and len(qi):
                    other = ~(ids[which][qi] == cids[s + ci])
                    qi, ci = qi[other], ci[other]
            if not len(qi):
                continue
            found = np.sqrt(S[qi, ci]) if metric == "l2" else S[qi, ci]
            qi, pos, score = (np.concatenate(x) for x in zip(held, (which[qi], s + ci, found), strict=True))
            value = _value(score, metric)
            at = np.lexsort((place[pos], -value, qi))
            at = at[(_ranks(qi[at]) <= k) & (value[at] > -np.inf)]
            held, value = (qi[at], pos[at], score[at]), value[at]
            counts = np.bincount(held[0], minlength=len(ids))
            full = np.flatnonzero(counts >= k)
            low[full] = value[np.cumsum(counts)[full] - 1]
        out.append((held[0] + qs, order[held[1]], held[2]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _scan_blocks(spark: SparkSession, asked: DataFrame, index: CellIndex, spec: KnnSpec) -> DataFrame:
    """Cells are dealt into groups as large as a task's memory allows, the queries of a group into blocks. A query is sent once to each
    group that it asks of, with a bit per cell, and a group once to each of its blocks of queries; a pair of them keeps the best ``k``
    of each query over all its cells."""
    n_cells, dim = index.n_cells, index.dim

    def count(batches):
        n = np.zeros(n_cells, np.int64)
        for batch in batches:
            n += np.bincount(batch.column("cells").flatten().to_numpy(zero_copy_only=False), minlength=n_cells)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n).astype(np.int32)), pa.array(n[n > 0])], names=["cell", "n"])

    asks_of = np.zeros(n_cells, np.int64)
    for r in asked.select("cells").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():      # a row per cell
        asks_of[r["cell"]] = r["n"]
    units, spans = _packed(index.sizes, asks_of, dim)

    def deal(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, QUERY_BLOCK):
                batch = whole.slice(start, QUERY_BLOCK)
                lists = batch.column("cells")
                mask = np.zeros((batch.num_rows, n_cells), bool)
                mask[np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False)),
                     lists.flatten().to_numpy(zero_copy_only=False)] = True
                for group, (first, last) in enumerate(spans):
                    part = mask[:, first:last + 1]
                    at = np.flatnonzero(part.any(axis=1))
                    if len(at):
                        bits = np.packbits(part[at], axis=1)
                        keep = pa.array(at)
                        yield pa.RecordBatch.from_arrays([batch.column("_qid").take(keep), batch.column("_qv").take(keep),
                                                          pa.array([x.tobytes() for x in bits], pa.binary()), pa.array(np.full(len(at), group, np.int32))],
                                                         names=["_qid", "_qv", "asks", "grp"])

    qid, qv = _types(asked, ["_qid", "_qv"])
    dealt = asked.select("_qid", "_qv", "cells").mapInArrow(deal, f"_qid {qid}, _qv {qv}, asks binary, grp int")
    sent = {r["grp"]: r["n"] for r in dealt.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}                             # a row per group
    # Blocks as large as memory allows, but enough of them for every core.
    most = max(QUERY_BLOCK, min(GROUP_ROWS, GROUP_BYTES // (8 * dim + 64), math.ceil(sum(sent.values()) / (2 * spark.sparkContext.defaultParallelism))))
    blocks = {group: math.ceil(n / most) for group, n in sent.items()}
    v = _vectors(spark, index)
    names = _columns(v)
    of_group = spark.createDataFrame(list(blocks.items()), "grp int, blocks int")
    left = (dealt.join(F.broadcast(of_group), "grp").withColumn("qb", F.pmod(F.xxhash64("_qid"), F.col("blocks")).cast("int"))
            .select("_qid", "_qv", "asks", "grp", "qb"))
    # The join with the asked cells prunes partitions at run time, so other cells are not read.
    of_unit = spark.createDataFrame([(cell, sub, group, blocks.get(group, 0)) for cell, sub, group in units],
                                    "cell int, sub int, grp int, blocks int").checkpoint()
    right = (v.join(F.broadcast(of_unit.where("blocks > 0")), ["cell", "sub"]).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select(*names, "_cv", "cell", "grp", "qb"))
    k, metric, exclude_self = spec.k, spec.metric, spec.exclude_self

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        qi, ci, score = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        cell = rows.column("cell").to_numpy()
        if queries.num_rows and rows.num_rows:
            first, last = spans[rows.column("grp")[0].as_py()]
            bits = np.frombuffer(b"".join(queries.column("asks").to_pylist()), np.uint8).reshape(queries.num_rows, -1)
            asks = np.unpackbits(bits, axis=1, count=last - first + 1).astype(bool)
            qi, ci, score = _topk_of_cells(queries.column("_qid").to_numpy(), _matrix(queries.column("_qv")), asks, rows.column("_cid").to_numpy(),
                                           rows.column("_ck").to_numpy(), _matrix(rows.column("_cv")), cell - first, k, metric, exclude_self)
        took = rows.take(pa.array(ci, pa.int64()))
        return pa.table([queries.column("_qid").take(pa.array(qi, pa.int64())), *[took.column(n) for n in names], took.column("cell"), pa.array(score, pa.float64())],
                        names=["_qid", *names, "cell", "score"])

    return (left.groupBy("grp", "qb").cogroup(right.groupBy("grp", "qb"))
            .applyInArrow(run, _candidate_schema(asked, v)))


def _merge_cells(found: DataFrame, spec: KnnSpec) -> DataFrame:
    from .knn import rank_candidates
    return rank_candidates(found, "_qid", "_ck", spec.k, spec.metric)


def _candidates(queries: DataFrame, index: CellIndex, spec: KnnSpec, query_id: str, query_vec: str, nprobe: int | None, exact: bool,
                strategy: str, first: int) -> tuple[DataFrame, list[DataFrame]]:
    """Candidates, and what was asked (a frame per round)."""
    spark = queries.sparkSession
    ensure_checkpoint_dir(spark)
    q = spread(queries.select(F.col(query_id).alias("_qid"), F.col(query_vec).alias("_qv")), "_qid")
    n = min(max(1, index.nprobe if nprobe is None else nprobe), index.n_cells)
    if not exact:
        asked = _ask(q, index, _nearest(index, n)).checkpoint()
        return _scan(spark, asked, index, spec, strategy=strategy), [asked]
    asked = _ask(q, index, _nearest(index, first)).checkpoint()
    near = _scan(spark, asked, index, spec, strategy=strategy).checkpoint()
    value = -F.round("score", 6) if index.metric == "l2" else F.round("score", 6)
    # The k-th best value so far; queries with fewer candidates have no bound.
    reached = (_merge_cells(near, spec).groupBy("_qid").agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("least")).where(F.col("n") >= spec.k)
               .select(F.col("_qid").alias("of"), "least"))
    rest = q.join(reached, F.col("_qid") == F.col("of"), "left").select("_qid", "_qv", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    done = _nearest(index, first)

    def wanted(m, least):
        return (_best_possible(m, index) >= least[:, None] - _SLACK) & ~done(m)

    more = _ask(rest, index, wanted).checkpoint()
    found = near.unionByName(_scan(spark, more.where(F.size("cells") > 0), index, spec, strategy=strategy))
    return found, [asked, more]


def search(index: CellIndex, queries: DataFrame, k: int = 5, *, query_id: str = "id", query_vec: str = "vector", nprobe: int | None = None,
           exact: bool = False, exclude_self: bool = False, query_out: str = "query_id", corpus_out: str = "id", as_lists: bool = False,
           strategy: str = "auto", first: int = 2) -> DataFrame:
    """Neighbours in the form of ``knn_join``: by ``nprobe`` cells (default: the calibrated number), or exact with bounds.

    Query ids are taken to be unique. Queries without a vector of the index's dimension (or, for cosine, a direction) have no neighbours.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    spec = KnnSpec(k, index.metric, exclude_self)
    found, _ = _candidates(queries, index, spec, query_id, query_vec, nprobe, exact, strategy, first)
    return _rename(_merge(found.drop("cell"), spec, index.carry, as_lists), index.carry, query_out, corpus_out, as_lists)


def search_report(index: CellIndex, queries: DataFrame, k: int = 5, *, query_id: str = "id", query_vec: str = "vector", nprobe: int | None = None,
                  exact: bool = False, first: int = 2) -> DataFrame:
    """One row: queries, rows, pairs of a query and a row that a search scores, and all pairs."""
    spec = KnnSpec(k, index.metric, False)
    _, asked = _candidates(queries, index, spec, query_id, query_vec, nprobe, exact, "auto", first)
    sizes = queries.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(index.sizes)], "cell int, rows bigint")
    all_asked = asked[0] if len(asked) == 1 else asked[0].unionByName(asked[1])
    scored = (all_asked.select(F.explode("cells").alias("cell")).join(F.broadcast(sizes), "cell")
              .agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("pairs_scored")))
    n = queries.count()
    return scored.select(F.lit(n).cast("long").alias("queries"), F.lit(index.rows).cast("long").alias("rows"), "pairs_scored",
                         F.lit(n * index.rows).cast("long").alias("pairs"))

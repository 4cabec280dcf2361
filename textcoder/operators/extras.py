"""Evaluation and retrieval extras described by the reference text.

All are DataFrame jobs over evaluation rows or candidate lists; none gathers a
group into one task except where the group is bounded (a candidate list of k,
B bootstrap replicates, a handful of classes).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import work_dir
from .postings import build_postings, search_postings, search_report
from .sampling import order_hash

HASH_SCALE = float(1 << 60)


# --------------------------------------------------------------------------- D1-D3 hierarchy
DEPTH = 4


def ancestors(nomenclature: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``(code, chain)``: each code with itself and its ancestors, nearest first.

    ``chain`` holds structs ``(level, node)`` found by walking ``parent_code`` upwards
    (``depth - 1`` joins on code), so codes need not be prefixes of each other. The
    walk ends at a row without a parent or with an unknown one. Of a repeated code
    the row of the highest level and parent counts."""
    one = (nomenclature.groupBy("code").agg(F.max(F.struct("level", "parent_code")).alias("r"))
           .select("code", "r.level", "r.parent_code"))
    up = one.select(F.col("code").alias("_node"), F.col("level").alias("_level"),
                    F.col("parent_code").alias("_next"))
    walk = one.select("code", F.col("parent_code").alias("_up"),
                      F.array(F.struct("level", F.col("code").alias("node"))).alias("chain"))
    step = F.array(F.struct(F.col("_level").alias("level"), F.col("_node").alias("node")))
    for _ in range(depth - 1):
        walk = walk.join(up, F.col("_up") == F.col("_node"), "left").select(
            "code", F.col("_next").alias("_up"),
            F.when(F.col("_node").isNull(), F.col("chain"))
            .otherwise(F.concat("chain", step)).alias("chain"))
    return walk.drop("_up")


def _counted_pairs(ev: DataFrame, nomenclature: DataFrame, truth: str, pred: str) -> DataFrame:
    """``(t, p, n, t_chain, p_chain)``: one row per pair of codes, so a code that most
    rows share is combined map-side before it meets its ancestors."""
    anc = ancestors(nomenclature)
    pairs = (ev.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p"))
             .agg(F.count(F.lit(1)).alias("n")))
    for c in ("t", "p"):
        side = anc.select(F.col("code").alias(f"_{c}"), F.col("chain").alias(f"{c}_chain"))
        pairs = pairs.join(side, F.col(c) == F.col(f"_{c}"), "left").drop(f"_{c}")
    return pairs


def _at_level(c: str, level: int) -> Column:
    """The ancestor (or the code itself) at a level; null if the chain has none."""
    return F.get(F.filter(f"{c}_chain", lambda x: x["level"] == level), 0)["node"]


def _above(c: str, steps: int) -> Column:
    return F.get(F.col(f"{c}_chain"), steps)["node"]


def hierarchical_accuracy(ev: DataFrame, nomenclature: DataFrame, depths=(1, 2, 3, 4),
                          truth: str = "true_code", pred: str = "pred_code") -> DataFrame:
    """Accuracy at each level: both codes have the same ancestor there. A code above
    that level, or one that the nomenclature lacks, stands for itself."""
    pairs = _counted_pairs(ev, nomenclature, truth, pred)
    aggs = [F.coalesce(F.sum("n"), F.lit(0)).alias("n")]
    for d in depths:
        same = F.coalesce(_at_level("p", d), "p") == F.coalesce(_at_level("t", d), "t")
        aggs.append(F.coalesce(F.sum(F.when(same, F.col("n"))), F.lit(0)).alias(f"c{d}"))
    rows = F.array(*[F.struct(F.lit(d).alias("depth"), F.col(f"c{d}").alias("n_correct"))
                     for d in depths])
    return (pairs.agg(*aggs).select("n", F.inline(rows))
            .select("depth", "n", "n_correct",
                    F.round(F.try_divide("n_correct", "n"), 6).alias("accuracy")))


def error_class(ev: DataFrame, nomenclature: DataFrame, truth: str = "true_code",
                pred: str = "pred_code") -> DataFrame:
    """``exact``, ``sibling`` (same parent), ``same_group`` (same grandparent),
    ``same_sector`` (same ancestor at level 1), ``far``, ``none`` (no prediction)."""
    cls = (F.when(F.col("p").isNull(), F.lit("none"))
           .when(F.col("p") == F.col("t"), F.lit("exact"))
           .when(_above("p", 1) == _above("t", 1), F.lit("sibling"))
           .when(_above("p", 2) == _above("t", 2), F.lit("same_group"))
           .when(_at_level("p", 1) == _at_level("t", 1), F.lit("same_sector"))
           .otherwise(F.lit("far")))
    return (_counted_pairs(ev, nomenclature, truth, pred)
            .groupBy(cls.alias("error_class")).agg(F.sum("n").alias("n")))


def sector_accuracy(ev: DataFrame, nomenclature: DataFrame, truth: str = "true_code",
                    pred: str = "pred_code") -> DataFrame:
    """D3: accuracy per level-1 ancestor of the true code (null: not in the nomenclature)."""
    ok = F.sum(F.when(F.col("p") == F.col("t"), F.col("n")))
    return (_counted_pairs(ev, nomenclature, truth, pred)
            .groupBy(_at_level("t", 1).alias("sector"))
            .agg(F.sum("n").alias("n"), F.coalesce(ok, F.lit(0)).alias("n_correct"))
            .withColumn("accuracy", F.round(F.col("n_correct") / F.col("n"), 6)))


# --------------------------------------------------------------------------- D4 bootstrap
def poisson1_thresholds(kmax: int = 12) -> list[float]:
    """CDF of Poisson(1) at 0..kmax (computed, not tabulated)."""
    out, acc, term = [], 0.0, math.exp(-1.0)
    for k in range(kmax + 1):
        acc += term
        out.append(acc)
        term /= (k + 1)
    return out


def poisson1_weight(u: Column, kmax: int = 12) -> Column:
    """Inverse CDF of Poisson(1) for a uniform ``u`` in [0, 1)."""
    expr = F.lit(kmax + 1)
    for k, c in reversed(list(enumerate(poisson1_thresholds(kmax)))):
        expr = F.when(u < F.lit(c), F.lit(k)).otherwise(expr)
    return expr


def bootstrap_accuracy(ev: DataFrame, key: str, replicates: int = 200, seed: int = 42,
                       level: float = 0.95) -> DataFrame:
    """Poisson bootstrap of the accuracy: each row gets a Poisson(1) weight per
    replicate from a seeded hash (no sampling state), replicates aggregate in one
    pass with map-side combining; the interval is the percentile of B values."""
    ok = F.coalesce(F.col("correct"), F.lit(False)).cast("long")
    rep = ev.select(key, ok.alias("_ok"),
                    F.explode(F.sequence(F.lit(-1), F.lit(replicates - 1))).alias("b"))
    u = order_hash(F.concat_ws(":", F.col("b").cast("string"), F.col(key).cast("string")),
                   seed).cast("double") / F.lit(HASH_SCALE)
    # Replicate -1 carries weight 1 on every row: the point estimate.
    w = rep.withColumn("w", F.when(F.col("b") < 0, F.lit(1)).otherwise(poisson1_weight(u)))
    per_b = (w.groupBy("b").agg(F.sum("w").alias("n_w"),
                                F.sum(F.col("w") * F.col("_ok")).alias("c_w"))
             .withColumn("acc", F.col("c_w") / F.col("n_w")))          # B + 1 rows
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    boot = F.when(F.col("b") >= 0, F.col("acc"))
    return per_b.agg(F.round(F.max(F.when(F.col("b") < 0, F.col("acc"))), 6).alias("estimate"),
                     F.round(F.percentile(boot, F.lit(lo)), 6).alias("lower"),
                     F.round(F.percentile(boot, F.lit(hi)), 6).alias("upper"),
                     F.count(boot).alias("replicates"))


# --------------------------------------------------------------------------- D5 P/R/F1
def precision_recall_f1(ev: DataFrame, truth: str = "true_code", pred: str = "pred_code"
                        ) -> DataFrame:
    """Per class ``tp, fp, fn, precision, recall, f1`` plus ``macro`` and
    ``weighted`` (by support) averages. Precision without a prediction and
    recall without a case are null and left out; the F1 of a class without a hit is 0 in both averages."""
    t = ev.select(F.col(truth).alias("cls"), F.lit(1).alias("_t"), F.lit(0).alias("_p"),
                  (F.col(pred) == F.col(truth)).cast("int").alias("_tp"))
    p = ev.where(F.col(pred).isNotNull()).select(F.col(pred).alias("cls"), F.lit(0).alias("_t"),
                                                 F.lit(1).alias("_p"), F.lit(0).alias("_tp"))
    c = (t.unionByName(p).groupBy("cls")
         .agg(F.sum("_tp").alias("tp"), F.sum("_t").alias("support"), F.sum("_p").alias("npred")))
    c = (c.withColumn("tp", F.coalesce("tp", F.lit(0)).cast("long"))
         .withColumn("fp", (F.col("npred") - F.col("tp")).cast("long"))
         .withColumn("fn", (F.col("support") - F.col("tp")).cast("long"))
         .withColumn("precision", F.try_divide(F.col("tp").cast("double"), F.col("npred")))
         .withColumn("recall", F.try_divide(F.col("tp").cast("double"), F.col("support")))
         .withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                                   F.col("precision") + F.col("recall")), F.lit(0.0))))
    per = c.select(F.col("cls").alias("class"), "tp", "fp", "fn",
                   *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")])
    avg = c.agg(F.avg("precision").alias("mp"), F.avg("recall").alias("mr"),
                F.avg("f1").alias("mf"),
                (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
                (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
                (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"),
                F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    rows = F.array(
        F.struct(F.lit("macro").alias("class"), F.col("mp").alias("precision"),
                 F.col("mr").alias("recall"), F.col("mf").alias("f1")),
        F.struct(F.lit("weighted").alias("class"), F.col("wp").alias("precision"),
                 F.col("wr").alias("recall"), F.col("wf").alias("f1")))
    summary = avg.select("tp", "fp", "fn", F.inline(rows)).select(
        "class", "tp", "fp", "fn", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")])
    return per.unionByName(summary)


# --------------------------------------------------------------------------- D6 triage
def triage(decisions: DataFrame, threshold: float = 0.5, conf: str = "confidence"
           ) -> DataFrame:
    """``queue`` = ``automatic`` when confidence >= threshold and a code exists,
    else ``review``. Write each queue with ``partitionBy('queue')``."""
    auto = (F.col(conf) >= F.lit(threshold)) & F.col("pred_code").isNotNull()
    return decisions.withColumn("queue", F.when(auto, "automatic").otherwise("review"))


# --------------------------------------------------------------------------- D7 BM25 + RRF
BM25_K1 = 1.2
BM25_B = 0.75
RRF_K = 60


def _term_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, terms, counts, length)``: distinct terms of a text as 64-bit hashes, ascending,
    with their counts (row-local; tokens and hashes are native, runs are counted on Arrow batches)."""
    def runs(batch: pa.Array) -> pa.Array:
        found = [np.unique(h, return_counts=True) for h in (x.values.to_numpy() for x in batch)]
        ends = pa.array(np.cumsum([0, *(len(t) for t, _ in found)]).astype(np.int32))
        none = np.zeros(0, np.int64)
        return pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([none, *(x[i] for x in found)]))) for i in (0, 1)]
            + [pa.array([int(n.sum()) for _, n in found], pa.int64())], names=["terms", "counts", "length"])

    hashed = F.coalesce(F.transform(tokens(text_col), lambda t: F.xxhash64(t)), F.array().cast("array<long>"))
    counted = F.arrow_udf(runs, "terms array<long>, counts array<long>, length long")(hashed)
    return df.select(F.col(id_col).alias("id"), counted.alias("_c")).select("id", "_c.*")


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int, *, query_id: str, query_text: str,
              doc_id: str, doc_text: str, path: str | None = None) -> DataFrame:
    """``(query_id, rank, code, score)``, the ``k`` best documents of each query by BM25.

    ``score = sum of count(t in q) idf(t) tf (k1 + 1) / (tf + k1 (1 - b + b |d| / avgdl))`` over
    terms (64-bit hashes, no buckets), from a stored inverted index (``postings``) at ``path``, by default
    one that is built for this search. Documents that share no term are left out."""
    path = path or work_dir(docs.sparkSession, "postings")
    bm25_index(docs, path, doc_id=doc_id, doc_text=doc_text)
    return bm25_search(queries, path, k, query_id=query_id, query_text=query_text)


def bm25_index(docs: DataFrame, path: str, *, doc_id: str, doc_text: str) -> None:
    """Write the inverted index of ``docs``, for many searches."""
    build_postings(docs, path, doc_id=doc_id, term_counts=lambda d: _term_counts(d, doc_id, doc_text), k1=BM25_K1, b=BM25_B)


def bm25_search(queries: DataFrame, path: str, k: int, *, query_id: str, query_text: str) -> DataFrame:
    """``bm25_topk`` in a stored index."""
    return search_postings(queries.sparkSession, path, queries, k, query_id=query_id,
                           term_counts=lambda q: _term_counts(q, query_id, query_text))


def bm25_report(queries: DataFrame, path: str, k: int, *, query_id: str, query_text: str) -> DataFrame:
    """Postings that a search in a stored index reads, against all postings of the queries' terms."""
    return search_report(queries.sparkSession, path, queries, k, query_id=query_id,
                         term_counts=lambda q: _term_counts(q, query_id, query_text))


def reciprocal_rank_fusion(*ranked: DataFrame, query_col: str = "query_id",
                           item_col: str = "code", k: int = 5, rrf_k: int = RRF_K) -> DataFrame:
    """RRF: ``sum 1 / (rrf_k + rank)`` over the input rankings; best ``k`` per query."""
    u = None
    for r in ranked:
        part = r.select(query_col, item_col, (F.lit(1.0) / (F.lit(rrf_k) + F.col("rank")))
                        .alias("rrf"))
        u = part if u is None else u.unionByName(part)
    s = u.groupBy(query_col, item_col).agg(F.sum("rrf").alias("rrf"))
    w = Window.partitionBy(query_col).orderBy(F.round("rrf", 9).desc(), F.col(item_col))
    return (s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select(query_col, "rank", item_col, F.round("rrf", 9).alias("rrf")))


# --------------------------------------------------------------------------- D8 rescoring
def vote_rescore(long_cands: DataFrame, k: int = 5, query_col: str = "query_id",
                 code_col: str = "code") -> DataFrame:
    """Second score = summed similarity of the candidates sharing a code (a
    weighted vote); keep the best ``k`` by (vote, similarity, id). Candidate lists
    are bounded (k' per query)."""
    r6 = F.round("score", 6)
    vote = F.sum(r6).over(Window.partitionBy(query_col, code_col))
    v = long_cands.withColumn("vote", F.round(vote, 6))
    w = Window.partitionBy(query_col).orderBy(F.col("vote").desc(), r6.desc(), F.col("id"))
    return (v.withColumn("rank2", F.row_number().over(w)).where(F.col("rank2") <= k)
            .select(query_col, F.col("rank2").alias("rank"), "id", code_col,
                    r6.alias("score"), "vote"))


# --------------------------------------------------------------------------- D10, D11
def hierarchy_violations(docs: DataFrame) -> DataFrame:
    """Rows whose parent is missing or whose level is not the parent's + 1."""
    parents = docs.select(F.col("code").alias("parent_code"), F.col("level").alias("_pl"))
    j = docs.where(F.col("level") > 1).join(parents, "parent_code", "left")
    bad = (F.when(F.col("_pl").isNull(), F.lit("missing parent"))
           .when(F.col("level") != F.col("_pl") + 1, F.lit("level is not parent level + 1")))
    return j.select("code", "level", "parent_code", bad.alias("problem")).where(
        F.col("problem").isNotNull())


def vector_checks(df: DataFrame, vec: str, dim: int | None = None) -> DataFrame:
    """Counts of null vectors, wrong dimension, NaN values and zero norms."""
    n_dim = F.size(vec)
    has_nan = F.exists(vec, lambda x: F.isnan(x))
    zero = F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) == 0
    extra = [F.count_if(n_dim != F.lit(dim)).alias("n_bad_dim")] if dim is not None else []
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(vec).isNull()).alias("n_null"),
                  F.max(n_dim).alias("max_dim"), F.min(n_dim).alias("min_dim"),
                  F.count_if(has_nan).alias("n_nan"), F.count_if(zero).alias("n_zero_norm"),
                  *extra)


# --------------------------------------------------------------------------- D12
def resume_classification(spark, rows: DataFrame, out_dir: str, classify, id_col: str = "id",
                          run_tag: str = "run") -> DataFrame:
    """Progressive output with restart: rows whose id is already in the output
    folder are skipped (anti join), the rest is classified and appended as a new
    part. Re-running after a crash finishes the remainder; re-running after
    success adds nothing."""
    from pyspark.errors import AnalysisException
    todo = rows
    try:
        done = spark.read.parquet(out_dir).select(id_col)   # raises if nothing was written
        todo = rows.join(done, id_col, "left_anti")
    except AnalysisException:
        pass                             # first run: nothing done yet
    out = classify(todo)
    out.write.mode("append").parquet(out_dir)
    return spark.read.parquet(out_dir)

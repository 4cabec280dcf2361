"""Retrieval-based coding: decisions, label lookup and evaluation rows.

A candidate list is the list form of ``knn_join`` (``codes``, ``scores`` in rank
order). The retrieval-only decision takes rank 1 with its score; a query with
no candidate gets a null code, confidence 0 and an empty list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluate import evaluation_columns
from .knn import knn_join

# Labels used for rows without a code or with an unknown code.
NOT_CODABLE = "Not codable"
LABEL_NOT_FOUND = "(label not found)"


def decide_top1(lists: DataFrame, codes: str = "codes", scores: str = "scores") -> DataFrame:
    """G9 + G10: ``pred_code, codable, confidence, retrieved_codes`` from candidate lists."""
    top_code = F.get(F.col(codes), 0)
    return (lists.withColumn("pred_code", top_code)
            .withColumn("codable", top_code.isNotNull())
            .withColumn("confidence", F.coalesce(F.get(F.col(scores), 0), F.lit(0.0)))
            .withColumn("retrieved_codes", F.coalesce(F.col(codes), F.array().cast("array<string>"))))


def retrieve_and_decide(queries: DataFrame, corpus: DataFrame, k: int = 5, *,
                        query_id: str, query_vec: str, corpus_id: str, corpus_vec: str,
                        code: str = "code", query_carry=(), metric: str = "cosine",
                        exclude_self: bool = False, key: str | None = None,
                        strategy: str = "auto", approximate: bool = False,
                        nprobe: int | None = None, dim: int | None = None, prepared=None) -> DataFrame:
    """Query rows -> ``(query_id, *query_carry, pred_code, codable, confidence,
    retrieved_codes, retrieved_scores)``; every query is kept (G10)."""
    if approximate:
        from .knn import knn_cells
        lists = knn_cells(queries, corpus, k, nprobe=nprobe, query_id=query_id,
                          query_vec=query_vec, corpus_id=corpus_id, corpus_vec=corpus_vec,
                          key=key, carry=[code], metric=metric, exclude_self=exclude_self,
                          as_lists=True)
        qc = queries.select(F.col(query_id).alias("query_id"), *query_carry)
        lists = qc.join(lists, "query_id", "left")
    else:
        lists = knn_join(queries, corpus, k, query_id=query_id, query_vec=query_vec,
                         corpus_id=corpus_id, corpus_vec=corpus_vec, key=key, carry=[code],
                         metric=metric, exclude_self=exclude_self, strategy=strategy,
                         as_lists=True, keep_empty=True, query_carry=query_carry, dim=dim,
                         prepared=prepared)
    out = decide_top1(lists, codes=code + "s", scores="scores")
    return out.select("query_id", *query_carry, "pred_code", "codable",
                      F.round("confidence", 6).alias("confidence"), "retrieved_codes",
                      F.transform(F.coalesce("scores", F.array().cast("array<double>")),
                                  lambda x: F.round(x, 6)).alias("retrieved_scores"))


def evaluation_rows(decisions: DataFrame, truth: str = "true_code") -> DataFrame:
    """G7/G8 evaluation record with hit / correct / correct-given-hit flags."""
    return evaluation_columns(decisions, truth=truth)


def attach_labels(df: DataFrame, labels: DataFrame, code: str = "code",
                  label_code: str = "code", label_col: str = "label") -> DataFrame:
    """J1 + P19: left lookup of a label per code.

    Null code -> ``Not codable`` and ``''`` as exported code; a code missing
    from the dictionary -> ``(label not found)``. The dictionary is a label
    table (one row per code); it is broadcast when Spark's size estimate is
    under the broadcast threshold, else the join shuffles.
    """
    lab = labels.select(F.col(label_code).alias("_lc"), F.col(label_col).alias("_label"))
    j = df.join(lab, F.col(code) == F.col("_lc"), "left")
    label = (F.when(F.col(code).isNull(), F.lit(NOT_CODABLE))
             .when(F.col("_lc").isNull(), F.lit(LABEL_NOT_FOUND))
             .otherwise(F.col("_label")))
    return j.withColumn("label", label).drop("_lc", "_label")

"""Registered queries: ``name -> fn(spark, root) -> DataFrame``.

Every query reads whole driver tables (or tables Spark derives from them).
Column names match the DuckDB statements in ``plans.oracle``.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import cell_index as ci
from ..operators import classify as cls
from ..operators import evaluate as ev
from ..operators import extras as ex
from ..operators import generation as gen
from ..operators import neighbour_graph as ng
from ..operators import sampling, subword
from ..operators import supervised as sup
from ..operators.embed import DEFAULT_DIM, dense_to_sparse, embed, embed_distinct, hashed_counts
from ..operators.knn import knn_cells, knn_join, recall_at_k
from ..operators.retrieval import attach_labels, evaluation_rows, retrieve_and_decide
from ..operators.validate import label_dict as _label_dict
from ..operators.validate import leaf_filter as _leaf_filter
from ..operators.validate import to_documents, to_points, validate_nomenclature
from ..session import work_dir
from ..sources import activity_csv as acsv
from ..sources import vector_table as vt
from ..sources.nomenclature import (nomenclature_from_part, read_labels, read_nomenclature,
                                    write_nomenclature)
from ..sources.tables import table

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}


def query(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise KeyError(f"query {name!r} registered twice")
        REGISTRY[name] = fn
        return fn
    return deco


# ----------------------------------------------------------------- retrieval on `embeddings`
# Leave-one-out search: every vector is a query against all the other vectors;
# its code is its label, the codes of its neighbours are the candidates.

def vectors(spark: SparkSession, root: str) -> DataFrame:
    return (table(spark, root, "embeddings")
            .select("vec_id", "embedding", F.col("label").cast("string").alias("code")))


def _loo_knn(spark, root, metric="cosine", **kw) -> DataFrame:
    e = vectors(spark, root)
    return knn_join(e, e, 5, query_id="vec_id", query_vec="embedding", corpus_id="vec_id",
                    corpus_vec="embedding", exclude_self=True, metric=metric, **kw)


def loo_decisions(spark, root, **kw) -> DataFrame:
    e = vectors(spark, root)
    return retrieve_and_decide(e, e, 5, query_id="vec_id", query_vec="embedding",
                               corpus_id="vec_id", corpus_vec="embedding", code="code",
                               query_carry=["code"], exclude_self=True, **kw
                               ).withColumnRenamed("code", "true_code")


def loo_evaluation(spark, root) -> DataFrame:
    return evaluation_rows(loo_decisions(spark, root))


@query("knn_top5")
def knn_top5(spark, root):
    r = _loo_knn(spark, root, carry=["code"])
    return r.select("query_id", "rank", "id", "code", F.round("score", 6).alias("score"))


@query("knn_dot")
def knn_dot(spark, root):
    r = _loo_knn(spark, root, metric="dot")
    return r.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query("knn_l2")
def knn_l2(spark, root):
    r = _loo_knn(spark, root, metric="l2")
    return r.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query("knn_blocks")
def knn_blocks(spark, root):
    """J2 through the shuffle plan (tiles + window), same result as knn_top5."""
    r = _loo_knn(spark, root, carry=["code"], strategy="blocks")
    return r.select("query_id", "rank", "id", "code", F.round("score", 6).alias("score"))


@query("knn_decision")
def knn_decision(spark, root):
    d = loo_decisions(spark, root)
    return d.select("query_id", "true_code", "pred_code", "codable", "confidence",
                    F.array_join("retrieved_codes", ", ").alias("retrieved_list"))


def nation_labels(spark, root) -> DataFrame:
    return table(spark, root, "nation").select(
        F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("label"))


@query("knn_lookup")
def knn_lookup(spark, root):
    d = loo_decisions(spark, root)
    j = attach_labels(d, nation_labels(spark, root), code="pred_code")
    return j.select("query_id", F.coalesce("pred_code", F.lit("")).alias("code"), "label",
                    "confidence")


@query("no_candidate")
def no_candidate(spark, root):
    """Vectors searched against the rows that have no stored vector (none here)."""
    e = vectors(spark, root)
    corpus = e.where(F.col("embedding").isNull())
    d = retrieve_and_decide(e, corpus, 5, query_id="vec_id", query_vec="embedding",
                            corpus_id="vec_id", corpus_vec="embedding", code="code")
    j = attach_labels(d, nation_labels(spark, root), code="pred_code")
    return j.select("query_id", F.coalesce("pred_code", F.lit("")).alias("code"), "label",
                    "codable", "confidence", F.size("retrieved_codes").alias("n_candidates"))


@query("rag_eval_rows")
def rag_eval_rows(spark, root):
    r = loo_evaluation(spark, root)
    return r.select("query_id", "true_code", "pred_code", "codable", "confidence",
                    F.array_join("retrieved_codes", ", ").alias("retrieved_list"),
                    "retriever_hit", "correct", "correct_given_hit")


@query("rag_metrics")
def rag_metrics(spark, root):
    return ev.rag_metrics(loo_evaluation(spark, root))


@query("rag_error_split")
def rag_error_split(spark, root):
    return ev.error_split(loo_evaluation(spark, root))


@query("precision_coverage")
def precision_coverage(spark, root):
    return ev.precision_coverage(loo_evaluation(spark, root))


@query("threshold_for_precision")
def threshold_for_precision(spark, root):
    return ev.threshold_for_precision(ev.precision_coverage(loo_evaluation(spark, root)), 0.95)


@query("confidence_box")
def confidence_box(spark, root):
    return ev.confidence_box(loo_evaluation(spark, root))


_SELF = dict(query_id="vec_id", query_vec="embedding", exclude_self=True)
_CORPUS = dict(corpus_id="vec_id", corpus_vec="embedding")


@query("knn_cells")
def knn_cells_q(spark, root):
    """Approximate neighbours by k-means cells, as many as a recall of 0.9 needs (rows-only check)."""
    e = vectors(spark, root)
    r = knn_cells(e, e, 5, **_SELF, **_CORPUS)
    return r.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query("knn_cells_all")
def knn_cells_all(spark, root):
    """J3 probing every cell: must equal exact search."""
    e = vectors(spark, root)
    r = knn_cells(e, e, 5, nprobe=1 << 20, **_SELF, **_CORPUS)
    return r.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query("cells_recall")
def cells_recall(spark, root):
    """Recall@5 of the cell search against exact search (rows-only check)."""
    e = vectors(spark, root)
    return recall_at_k(knn_cells(e, e, 5, **_SELF, **_CORPUS), knn_join(e, e, 5, **_SELF, **_CORPUS))


def _vector_index(spark, root):
    return ci.build_index(vectors(spark, root), work_dir(spark, "cells"), **_CORPUS)


@query("index_exact")
def index_exact(spark, root):
    """J2 by a stored index whose bounds drop cells: equals exact search."""
    r = ci.search(_vector_index(spark, root), vectors(spark, root), 5, exact=True, **_SELF)
    return r.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query("index_pairs")
def index_pairs(spark, root):
    """Pairs that searches in a stored index score (rows-only check)."""
    index, e = _vector_index(spark, root), vectors(spark, root)
    kw = dict(query_id="vec_id", query_vec="embedding")
    return (ci.search_report(index, e, 5, **kw).withColumn("search", F.lit("probes"))
            .unionByName(ci.search_report(index, e, 5, exact=True, **kw).withColumn("search", F.lit("exact"))))


@query("knn_graph")
def knn_graph(spark, root):
    """Approximate neighbours of all rows by neighbour-graph refinement (rows-only check)."""
    graph = ng.build_graph(vectors(spark, root), id_col="vec_id", vec_col="embedding")
    return ng.neighbours(graph, 5).withColumn("score", F.round("score", 6))


@query("graph_recall")
def graph_recall(spark, root):
    """Recall@5 of the neighbour graph, and the distances it took against all pairs (rows-only check)."""
    e = vectors(spark, root)
    graph = ng.build_graph(e, id_col="vec_id", vec_col="embedding")
    found = recall_at_k(ng.neighbours(graph, 5), knn_join(e, e, 5, **_SELF, **_CORPUS))
    return (found.withColumn("distances", F.lit(graph.distances).cast("long"))
            .withColumn("all_pairs", F.lit(graph.all_pairs).cast("long")).withColumn("rounds", F.lit(graph.rounds)))


# ----------------------------------------------------------------- nomenclature from `part`


def raw_nomenclature(spark, root) -> DataFrame:
    return nomenclature_from_part(table(spark, root, "part"))


def nomenclature_docs(spark, root) -> DataFrame:
    return to_documents(validate_nomenclature(raw_nomenclature(spark, root)))


@query("validate_nomenclature")
def validate_nomenclature_q(spark, root):
    v = validate_nomenclature(raw_nomenclature(spark, root))
    return v.select("CODE", "LEVEL", "level_num", "error")


@query("assemble_text")
def assemble_text_q(spark, root):
    return nomenclature_docs(spark, root).select("code", "level", "text")


@query("leaf_filter")
def leaf_filter_q(spark, root):
    return _leaf_filter(nomenclature_docs(spark, root)).select("code", "heading", "parent_code")


@query("point_ids")
def point_ids(spark, root):
    return nomenclature_docs(spark, root).select("code", tx.uuid5("code").alias("id"))


@query("payload")
def payload(spark, root):
    """P10 + P11: points of the leaf documents, payload struct flattened."""
    docs = _leaf_filter(nomenclature_docs(spark, root)).withColumn("vector", F.array())
    return to_points(docs).select("id", "payload.*")


@query("label_dict")
def label_dict_q(spark, root):
    return _label_dict(raw_nomenclature(spark, root))


def faulty_rows(spark, root) -> DataFrame:
    """Leaf rows that break, by ``p_partkey``, one rule each (two of ten are sound)."""
    k, null = F.col("p_partkey") % 10, F.lit(None).cast("string")
    code = F.col("p_partkey").cast("string")
    return table(spark, root, "part").select(
        F.when(k == 0, null).when(k == 1, "").otherwise(code).alias("CODE"),
        F.when(k == 2, null).when(k == 3, " \t ").otherwise(F.col("p_name")).alias("HEADING"),
        F.when(k == 4, null).when(k == 5, "4.0").when(k == 6, "7").when(k == 7, " 4 ").otherwise(F.lit("4")).alias("LEVEL"),
        F.when(k == 8, "  ").otherwise(F.col("p_type")).alias("PARENT_CODE"), F.col("p_name").alias("Includes"),
        null.alias("IncludesAlso"), null.alias("Excludes"))


@query("validate_faulty")
def validate_faulty(spark, root):
    """S1 + P2-P4, P9: rows with faults written as tab-separated files, read back and validated."""
    path = work_dir(spark, "nomenclature_tsv")
    write_nomenclature(faulty_rows(spark, root), path)
    v = validate_nomenclature(read_nomenclature(spark, path))
    return v.select("Includes", "LEVEL", "level_num", "error")


@query("label_last_wins")
def label_last_wins(spark, root):
    """S2 + P6: labels scanned from files in document order; a code's last row with a heading counts."""
    path, null = work_dir(spark, "labels_tsv"), F.lit(None).cast("string")
    rows = table(spark, root, "documents").orderBy("doc_id").select(
        F.concat(F.lit(" "), "source").alias("CODE"),
        F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("document "), F.col("doc_id").cast("string"), F.lit(" "))).alias("HEADING"),
        *[null.alias(c) for c in ("LEVEL", "PARENT_CODE", "Includes", "IncludesAlso", "Excludes")])
    write_nomenclature(rows, path)
    return _label_dict(read_labels(spark, path))


# ----------------------------------------------------------------- text
@query("clean_text")
def clean_text_q(spark, root):
    d = table(spark, root, "documents")
    c = tx.clean_text("text")
    return d.select("doc_id", c.alias("clean"), F.length(c).alias("n_chars_clean"))


@query("text_scalars")
def text_scalars(spark, root):
    p = table(spark, root, "pages")
    return p.select("page_id", F.lower("url").alias("url_lower"),
                    tx.basename_stem("url").alias("url_stem"),
                    tx.char_count("html", "<").alias("n_tags"),
                    F.length(tx.strip("html")).alias("n_chars_stripped"))


# ----------------------------------------------------------------- embeddings of text
EMBED_DIM = DEFAULT_DIM


@query("hash_embed")
def hash_embed(spark, root):
    """G1 default embedder on Arrow batches, shown as its non-zero entries."""
    d = table(spark, root, "documents").select("doc_id", "text")
    v = embed(d, "text", dim=EMBED_DIM, id_col="doc_id")
    s = dense_to_sparse(v, "doc_id")
    return s.select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


@query("hash_embed_native")
def hash_embed_native(spark, root):
    """The same vectors computed natively (explode + aggregate)."""
    d = table(spark, root, "documents")
    s = hashed_counts(d, "doc_id", "text", EMBED_DIM)
    return s.select("doc_id", F.col("bucket").cast("int").alias("bucket"),
                    F.round("weight", 6).alias("weight"))


@query("dedupe_embed")
def dedupe_embed(spark, root):
    """Each distinct text embedded once and joined back to every row."""
    d = table(spark, root, "documents").select("doc_id", "text")
    v = embed_distinct(d, "text", dim=EMBED_DIM)
    s = dense_to_sparse(v, "doc_id")
    return s.select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


def leaf_vectors(spark, root) -> DataFrame:
    leaves = _leaf_filter(nomenclature_docs(spark, root)).select("code", "text")
    return embed(leaves, "text", dim=EMBED_DIM, id_col="code")


@query("text_knn")
def text_knn(spark, root):
    """G1 + J2: every part name searched among the leaf documents."""
    q = table(spark, root, "part").select("p_partkey", "p_name")
    qv = embed(q, "p_name", dim=EMBED_DIM, id_col="p_partkey")
    r = knn_join(qv, leaf_vectors(spark, root), 5, query_id="p_partkey", query_vec="vector",
                 corpus_id="code", corpus_vec="vector", dim=EMBED_DIM)
    return r.select("query_id", "rank", F.col("id").alias("code"),
                    F.round("score", 6).alias("score"))


# ----------------------------------------------------------------- vector table


def _leaf_points(spark, root) -> DataFrame:
    docs = _leaf_filter(nomenclature_docs(spark, root))
    return to_points(embed(docs, "text", dim=EMBED_DIM, id_col="code", dtype="float"))


@query("build_vectors")
def build_vectors(spark, root):
    """G2 + S7 + S8 + S10: leaf documents -> vectors -> points -> new table -> read back."""
    path = work_dir(spark, "vectors")
    vt.create_or_replace(spark, path, EMBED_DIM, "cosine")
    vt.upsert(spark, path, _leaf_points(spark, root))
    pts = vt.read_points(spark, path)
    return pts.select("id", "payload.code", "payload.level", F.size("vector").alias("dim"),
                      F.size(F.filter("vector", lambda x: x != 0)).alias("n_nonzero"))


@query("upsert_twice")
def upsert_twice(spark, root):
    """S8 idempotence: the same points upserted twice leave one row per id."""
    path = work_dir(spark, "vectors")
    vt.create_or_replace(spark, path, EMBED_DIM, "cosine")
    pts = _leaf_points(spark, root)
    vt.upsert(spark, path, pts)
    report = vt.upsert(spark, path, pts)
    n_ids = vt.read_points(spark, path).select("id").distinct().count()
    return report.select("version", "n_rejected", "n_rows", F.lit(n_ids).cast("bigint").alias("n_ids"))


def _embedding_points(spark, root) -> DataFrame:
    none = F.lit(None)
    return vectors(spark, root).select(
        F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"),
        F.struct(F.col("code"), F.lit(4).alias("level"), none.cast("string").alias("parent_code"),
                 F.lit("first").alias("text")).alias("payload"), "vec_id")


@query("upsert_delta")
def upsert_delta(spark, root):
    """A table loaded once, then a change of every hundredth point, with one new point: what it holds, and what was written."""
    path = work_dir(spark, "vectors")
    vt.create_or_replace(spark, path, 64, "cosine")
    points = _embedding_points(spark, root)
    vt.upsert(spark, path, points)
    changed = points.where("vec_id % 100 = 0").withColumn("payload", F.col("payload").withField("text", F.lit("second")))
    added = changed.where("vec_id = 0").withColumn("id", F.lit("new"))
    vt.upsert(spark, path, changed.unionByName(added))
    rows = vt.commits(spark, path).where("kind = 'delta'").agg(F.max_by("rows", "version")).first()[0]
    return (vt.read_points(spark, path).select("id", "payload.code", "payload.text", F.size("vector").alias("dim"))
            .withColumn("rows_written", F.lit(rows).cast("long")))


@query("upsert_rejects")
def upsert_rejects(spark, root):
    """Points with a null vector, of another dimension or without id are refused with the reason, the others stored."""
    path = work_dir(spark, "vectors")
    vt.create_or_replace(spark, path, 64, "cosine")
    points = _embedding_points(spark, root)
    faulty = points.withColumn("vector", F.when(F.col("vec_id") % 7 == 1, None).when(F.col("vec_id") % 7 == 2, F.slice("vector", 1, 3))
                               .otherwise(F.col("vector"))).withColumn("id", F.when(F.col("vec_id") % 11 != 5, F.col("id")))
    report = vt.upsert(spark, path, faulty).first()
    refused = vt.read_rejects(spark, path, report["version"]).select("id", "why")
    return refused.unionByName(vt.read_points(spark, path).select("id", F.lit("stored").alias("why")))


@query("table_exists")
def table_exists_q(spark, root):
    """Tables found under a folder after creating one (rows-only check)."""
    base = work_dir(spark, "tables")
    vt.create_or_replace(spark, f"{base}/leaves", EMBED_DIM, "cosine")
    vt.upsert(spark, f"{base}/leaves", _leaf_points(spark, root))
    return vt.list_tables(spark, base).withColumn(
        "n_points", F.lit(vt.table_count(spark, f"{base}/leaves")))


# ----------------------------------------------------------------- prompts and generation


def part_candidates(spark, root) -> DataFrame:
    """Every part name searched among the leaf documents; ordered candidate arrays."""
    q = table(spark, root, "part").select(
        "p_partkey", "p_name",
        F.concat_ws(".", "p_type", "p_brand", F.col("p_size").cast("string"),
                    F.col("p_partkey").cast("string")).alias("true_code"))
    qv = embed(q, "p_name", dim=EMBED_DIM, id_col="p_partkey")
    return knn_join(qv, leaf_vectors(spark, root), 5, query_id="p_partkey", query_vec="vector",
                    corpus_id="code", corpus_vec="vector", carry=["text"], as_lists=True,
                    keep_empty=True, query_carry=["p_name", "true_code"], corpus_out="code",
                    dim=EMBED_DIM)


@query("prompt_build")
def prompt_build(spark, root):
    p = gen.build_prompts(part_candidates(spark, root), "p_name", texts="texts", codes="codes")
    return p.select("query_id", "codes_list", "user")


def coded_parts(spark, root, reference_fallback: bool = False) -> DataFrame:
    c = part_candidates(spark, root).withColumn("response", gen.top_candidate_response())
    c = c.withColumn("parsed", gen.parse_response("response"))
    return gen.apply_fallback(c, reference_fallback=reference_fallback)


@query("response_parse")
def response_parse(spark, root):
    c = part_candidates(spark, root).withColumn("response", gen.top_candidate_response())
    p = c.select("query_id", gen.parse_response("response").alias("r"))
    return p.select("query_id", "r.nace_code", "r.codable", "r.confidence", "r.error")


@query("response_parse_events")
def response_parse_events(spark, root):
    """G4 on text that is JSON but not a valid answer (``events.props``)."""
    e = table(spark, root, "events").select("event_id", gen.parse_response("props").alias("r"))
    return e.select("event_id", "r.nace_code", "r.codable", "r.confidence", "r.error")


@query("response_parse_dirty")
def response_parse_dirty(spark, root):
    """G4 on answers with white space around them, codes that are no text, and text after the object."""
    d, kind = table(spark, root, "documents"), F.col("doc_id") % 6
    answer = '{"nace_code": %s, "codable": true, "confidence": %s}'
    response = (F.when(kind == 0, F.format_string("\n" + answer % ('"%s"', "0.5") + "\n\t", "lang"))
                .when(kind == 1, F.lit(answer % ("12.3", "0.5"))).when(kind == 2, F.lit(answer % ('{"x": 1}', "0.5")))
                .when(kind == 3, F.lit('{"nace_code": null, "codable": "no", "confidence": "0.25"}'))
                .when(kind == 4, F.format_string(answer % ('"%s"', "0.5") + " done", "lang"))
                .otherwise(F.format_string("\t" + answer % ('"%s"', "1.5"), "source")))
    p = d.select("doc_id", response.alias("response")).select("doc_id", gen.parse_response("response").alias("r"))
    return p.select("doc_id", "r.nace_code", "r.codable", "r.confidence", "r.error")


@query("prompt_slots")
def prompt_slots(spark, root):
    """F10 on activities and candidates that themselves hold slot names."""
    d = table(spark, root, "documents").select(
        "doc_id", F.concat(F.lit("{codes} "), "source", F.lit(" {descriptions}")).alias("activity"),
        F.array(F.concat("lang", F.lit(" {activity}"))).alias("texts"), F.array("source").alias("codes"))
    return gen.build_prompts(d, "activity").select("doc_id", "activity", F.col("user").alias("prompt"))


@query("fallback_rows")
def fallback_rows(spark, root):
    """G6 with the reference's fallback: failed answers lose code and candidates."""
    e = (table(spark, root, "events")
         .select("event_id", F.array().cast("array<string>").alias("codes"),
                 gen.parse_response("props").alias("parsed")))
    f = gen.apply_fallback(e, reference_fallback=True)
    return f.select("event_id", "pred_code", "codable", "confidence",
                    F.size("retrieved_codes").alias("n_candidates"), "error")


def asked_documents(spark, root) -> DataFrame:
    """A request per document, with two candidate codes; every third answer will fail."""
    return table(spark, root, "documents").select(
        "doc_id", F.array("source", "lang").alias("codes"), F.lit("Answer in JSON.").alias("system"),
        F.concat((F.col("doc_id") % 3).cast("string"), F.lit(":"), "source").alias("user"))


def _answer(systems, users):
    """A generator that fails as a whole if one of its requests starts with 0, and answers 1 badly."""
    if any(u.startswith("0") for u in users):
        raise ValueError("refused")
    return [json.dumps({"nace_code": u[2:], "codable": True, "confidence": 0.5 if u[0] == "2" else 2}) for u in users]


@query("generate_rows")
def generate_rows(spark, root):
    """G5 + G6: of a batch only the refused rows lose their answer; candidates kept and emptied."""
    g = gen.generate(asked_documents(spark, root), _answer)
    g = g.withColumn("parsed", gen.parse_response("response"))
    kept = gen.apply_fallback(g).withColumn("n_kept", F.size("retrieved_codes"))
    both = gen.apply_fallback(kept, reference_fallback=True)
    return both.select("doc_id", "gen_error", "error", "pred_code", "codable", "confidence", "n_kept",
                       F.size("retrieved_codes").alias("n_emptied"))


@query("batch_coding")
def batch_coding(spark, root):
    """G7 + G8: one evaluation record per part name."""
    ev_rows = evaluation_rows(coded_parts(spark, root))
    return ev_rows.select("query_id", F.col("p_name").alias("activity"), "true_code",
                          "pred_code", "codable", "confidence",
                          F.array_join("retrieved_codes", ", ").alias("retrieved_list"),
                          "retriever_hit", "correct", "correct_given_hit", "error")


# ----------------------------------------------------------------- labelled examples, splits

SEED = 42


def labelled(spark, root) -> DataFrame:
    """S3: labelled examples ``(doc_id, label, code)`` = documents' text and language."""
    return table(spark, root, "documents").select("doc_id", F.col("text").alias("label"),
                                                  F.col("lang").alias("code"))


def labelled_split(spark, root) -> DataFrame:
    return sampling.split(labelled(spark, root), "doc_id", (0.70, 0.15, 0.15),
                          ("train", "val", "test"), seed=SEED)


@query("scan_labelled")
def scan_labelled(spark, root):
    return labelled(spark, root)


@query("n_unique")
def n_unique_q(spark, root):
    return ev.n_unique(table(spark, root, "documents"), "source")


@query("value_counts_top10")
def value_counts_top10(spark, root):
    return ev.value_counts(table(spark, root, "documents"), "source", 10)


@query("distinct_codes")
def distinct_codes(spark, root):
    return table(spark, root, "documents").select(F.col("source").alias("code")).distinct()


@query("split_assign")
def split_assign(spark, root):
    return labelled_split(spark, root).select("doc_id", "split")


@query("split_sizes")
def split_sizes_q(spark, root):
    return labelled_split(spark, root).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("missing_codes")
def missing_codes(spark, root):
    """Codes of the whole set that the training split lacks."""
    s = labelled_split(spark, root)
    train = s.where(F.col("split") == "train").select("code")
    return s.select("code").distinct().join(train, "code", "left_anti")


@query("missing_rare_codes")
def missing_rare_codes(spark, root):
    """J7/T1 where codes have few rows: some get none into the training split."""
    rare = labelled_split(spark, root).select(
        F.concat_ws("-", "code", F.floor(F.col("doc_id") / 3).cast("string")).alias("code"), "split")
    train = rare.where(F.col("split") == "train").select("code")
    return rare.select("code").distinct().join(train, "code", "left_anti")


@query("label_encode")
def label_encode(spark, root):
    """M2: sorted distinct training codes -> 0..n-1 (Spark ML ``StringIndexer``)."""
    from ..operators.supervised import fit_label_indexer
    s = labelled_split(spark, root)
    model = fit_label_indexer(s.where(F.col("split") == "train"))
    return spark.createDataFrame([(c, i) for i, c in enumerate(model.labels)],
                                 "code string, code_index int")


@query("sample_100")
def sample_100(spark, root):
    return sampling.sample(table(spark, root, "documents").select("doc_id", "lang"), 100,
                           "doc_id", seed=SEED)


@query("head_n")
def head_n(spark, root):
    return (table(spark, root, "documents").select("doc_id", "lang", "source")
            .orderBy("doc_id").limit(10))


@query("word_freq")
def word_freq(spark, root):
    """Word counts over the training texts only."""
    tr = labelled_split(spark, root).where(F.col("split") == "train")
    return (tr.select(F.explode(tx.tokens("label")).alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")))


@query("latest_run")
def latest_run(spark, root):
    """Newest run by start time (events stand for logged runs)."""
    from ..sources.runs import latest_run_id
    runs = table(spark, root, "events").select(
        F.concat(F.lit("run-"), F.col("event_id").cast("string")).alias("run_id"),
        F.col("ts").alias("start_time"))
    return latest_run_id(runs)


@query("preview_100")
def preview_100(spark, root):
    """L4: the first 100 classified rows in input order."""
    c = coded_parts(spark, root)
    return (c.select("query_id", "pred_code", "confidence").orderBy("query_id").limit(100))


@query("array_preview")
def array_preview(spark, root):
    """vector length and its first 8 values."""
    e = table(spark, root, "embeddings")
    return (e.select("vec_id", F.size("embedding").alias("dim"),
                     F.posexplode(F.slice("embedding", 1, 8)).alias("pos", "value"))
            .select("vec_id", "dim", "pos", F.round(F.col("value").cast("double"), 6)
                    .alias("value")))


# ----------------------------------------------------------------- supervised classifier

VOCAB_SIZE = 5000
_TRAINED: dict[tuple[str, str], tuple[list, object, DataFrame]] = {}


def trained(spark, root):
    """Vocabulary + early-stopped model for a dataset, trained once per session.

    The encoded texts are not kept: pieces take many times the bytes of their
    text. A query encodes the rows that it reads, the test split only where it
    needs no more.
    """
    key = (spark.sparkContext.applicationId, root)
    if key not in _TRAINED:
        s = labelled_split(spark, root)
        tr = s.where(F.col("split") == "train")
        vocab = subword.train_vocabulary(spark, subword.word_counts(tr, "label"), VOCAB_SIZE)
        rows = [tuple(r) for r in vocab.collect()]            # bounded by VOCAB_SIZE
        vdf = spark.createDataFrame(rows, "token_id int, token string")
        res = sup.train(subword.encode(tr, "label", vdf),
                        subword.encode(s.where(F.col("split") == "val"), "label", vdf),
                        vocab_size=VOCAB_SIZE)
        _TRAINED[key] = (rows, res, s)
    rows, res, _ = _TRAINED[key]
    return spark.createDataFrame(rows, "token_id int, token string"), res


def encoded_split(spark, root, split: str | None = None) -> DataFrame:
    """The labelled texts, or one split of them, encoded; the filter comes before the Python step, which Catalyst can't push it through."""
    vocab, _ = trained(spark, root)
    s = _TRAINED[(spark.sparkContext.applicationId, root)][2]
    return subword.encode(s if split is None else s.where(F.col("split") == split), "label", vocab)


def test_docs(spark, root) -> DataFrame:
    return encoded_split(spark, root, "test")


@query("subword_vocab")
def subword_vocab(spark, root):
    return trained(spark, root)[0]


@query("subword_encode")
def subword_encode(spark, root):
    e = encoded_split(spark, root)
    return e.select("doc_id", F.size("ids").alias("n_tokens"),
                    F.size(F.array_distinct(F.transform("pieces", lambda p: p["word_id"])))
                    .alias("n_words"),
                    F.size(F.filter("pieces", lambda p: p["token"] == subword.UNK)).alias("n_unk"))


FIXED_LEN = 10


@query("encode_fixed")
def encode_fixed(spark, root):
    """M4 fixed-length form over a vocabulary of single letters and digits."""
    chars = "abcdefghijklmnopqrstuvwxyz0123456789"
    toks = [subword.PAD, subword.UNK, *chars, *[subword.CONT + c for c in chars]]
    vocab = spark.createDataFrame(list(enumerate(toks)), "token_id int, token string")
    d = table(spark, root, "documents").select("doc_id", "text")
    e = subword.encode(d, "text", vocab, max_len=FIXED_LEN)
    return e.select("doc_id", F.concat_ws(" ", F.transform("ids", lambda i: i.cast("string"))).alias("ids"))


@query("vocab_join")
def vocab_join(spark, root):
    """Every training word looked up as a whole token (unknown -> [UNK] id)."""
    vocab, _ = trained(spark, root)
    words = word_freq(spark, root).select(F.col("word").alias("token"), "n")
    return subword.vocab_lookup(words, vocab)


@query("train_predict")
def train_predict(spark, root):
    _, res = trained(spark, root)
    return sup.predict_topk(res.model, test_docs(spark, root), 1).select("doc_id", "code",
                                                                        "confidence")


@query("predict_topk")
def predict_topk(spark, root):
    _, res = trained(spark, root)
    return sup.predict_topk(res.model, test_docs(spark, root), sup.DEFAULT_TOP_K)


@query("test_accuracy")
def test_accuracy(spark, root):
    _, res = trained(spark, root)
    t = test_docs(spark, root)
    pred = sup.predict_topk(res.model, t, 1).select("doc_id", F.col("code").alias("pred"))
    return ev.accuracy(pred, t.select("doc_id", F.col("code").alias("truth")), "doc_id",
                       "pred", "truth")


@query("token_attrib")
def token_attrib(spark, root):
    _, res = trained(spark, root)
    return sup.token_attributions(res.model, test_docs(spark, root))


@query("word_attrib")
def word_attrib(spark, root):
    _, res = trained(spark, root)
    t = test_docs(spark, root)
    return sup.word_attributions(sup.token_attributions(res.model, t), t)


@query("char_attrib")
def char_attrib(spark, root):
    _, res = trained(spark, root)
    return sup.char_attributions(sup.token_attributions(res.model, test_docs(spark, root)))


@query("model_round_trip")
def model_round_trip(spark, root):
    """A saved and reloaded model predicts the same codes."""
    from ..sources.runs import load_model, save_model
    _, res = trained(spark, root)
    path = save_model(res.model, work_dir(spark, "model"))
    t = test_docs(spark, root)
    a = sup.predict_topk(res.model, t, 1).select("doc_id", F.col("code").alias("a"))
    b = sup.predict_topk(load_model(path), t, 1).select("doc_id", F.col("code").alias("b"))
    return a.join(b, "doc_id", "full").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == F.col("b")).alias("n_same"))


@query("classify_batch_supervised")
def classify_batch_supervised(spark, root):
    """G11 supervised path on raw texts, by a saved and loaded artefact (model, vocabulary, metadata)."""
    from ..sources.runs import load_artefact, save_model
    vocab, res = trained(spark, root)
    path = save_model(res.model, work_dir(spark, "artefact"), vocab,
                      {"vocab_size": VOCAB_SIZE, "max_iter": res.best_iter})
    model, words, _ = load_artefact(spark, path)
    docs = table(spark, root, "documents")
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("activity_description"))
    labels = docs.select(F.col("lang").alias("code"), F.upper("lang").alias("label")).distinct()
    return cls.classify_supervised(rows, model, words, labels).select(*acsv.EXPORT_COLUMNS)


@query("run_log")
def run_log(spark, root):
    """S13 + L5: log the training run and read back the latest run."""
    from ..sources.runs import latest_run_id, log_run, read_runs
    _, res = trained(spark, root)
    runs = work_dir(spark, "runs")
    rid = log_run(spark, runs, {"vocab_size": VOCAB_SIZE, "max_iter": res.best_iter},
                  {"val_log_loss": min(ll for _, ll in res.history)})
    latest = latest_run_id(read_runs(spark, runs))
    return latest.select((F.col("run_id") == F.lit(rid)).alias("is_latest"))


# ----------------------------------------------------------------- CSV ingest, export, stream


def part_activity_rows(spark, root) -> DataFrame:
    return table(spark, root, "part").select(F.col("p_partkey").cast("string").alias("id"),
                                             F.col("p_name").alias("activity_description"))


def nomenclature_labels(spark, root) -> DataFrame:
    return _label_dict(raw_nomenclature(spark, root))


@query("csv_round_trip")
def csv_round_trip(spark, root):
    """S4 + S5: documents written as an activity CSV (id column, quoted multi-line
    texts, one file per partition) and read back with the upload rules."""
    path = work_dir(spark, "activity_csv")
    docs = table(spark, root, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("activity_description"))
    (docs.write.mode("overwrite").option("header", True).option("quote", '"')
     .option("escape", '"').csv(path))
    return acsv.read_activity_csv(spark, path, keep_id=True)


@query("csv_sequence_ids")
def csv_sequence_ids(spark, root):
    """S4 rule 6 + W2: a header-less two-column file; ids are 1..n in file order."""
    path = work_dir(spark, "activity_csv")
    rows = (table(spark, root, "part").orderBy("p_partkey")     # part files in key order
            .select(F.col("p_partkey").cast("string"), "p_name"))
    rows.write.mode("overwrite").option("header", False).option("sep", ";").csv(path)
    return acsv.read_activity_csv(spark, path)


@query("classify_batch")
def classify_batch(spark, root):
    """G11 retrieval path over every part name, labels from the nomenclature."""
    out = cls.classify_retrieval(part_activity_rows(spark, root), leaf_vectors(spark, root),
                                 nomenclature_labels(spark, root))
    return out.select(*acsv.EXPORT_COLUMNS)


@query("json_to_csv")
def json_to_csv(spark, root):
    """Classification rows as JSON arrays of 256 rows, parsed back and written."""
    out = cls.classify_retrieval(part_activity_rows(spark, root), leaf_vectors(spark, root),
                                 nomenclature_labels(spark, root)).select(*acsv.EXPORT_COLUMNS)
    chunks = (cls.with_chunks(out).groupBy("chunk")     # groups of at most 256 rows
              .agg(F.to_json(F.collect_list(F.struct(*acsv.EXPORT_COLUMNS))).alias("rows_json")))
    return acsv.rows_json_to_csv(chunks, work_dir(spark, "export_csv"))


def _stream_job(spark, root, base: str):
    """Run the incremental classification over part names arriving as 8 files.

    The corpus (leaf vectors) and the label table do not change during the
    stream: the corpus is collected and broadcast once (``prepare_corpus``) and
    the labels persisted, instead of being rebuilt by every micro-batch; both
    are released when the stream has finished. A corpus over the broadcast
    bound falls back to the per-batch join.
    """
    from ..streaming.classify_stream import run_classification_stream
    part_activity_rows(spark, root).repartition(8, "id").write.mode("overwrite").parquet(
        f"{base}/in")
    from ..operators.knn import prepare_corpus
    leaves = leaf_vectors(spark, root)
    prepared = prepare_corpus(leaves, corpus_id="code", corpus_vec="vector", carry=["code"],
                              dim=EMBED_DIM)
    labels = nomenclature_labels(spark, root).persist()
    try:
        return run_classification_stream(
            spark, f"{base}/in", f"{base}/out", f"{base}/chk",
            lambda b: cls.classify_retrieval(b, leaves, labels, prepared=prepared)
            .select(*acsv.EXPORT_COLUMNS))
    finally:
        if prepared is not None:
            prepared.release()
        labels.unpersist()


@query("classify_stream")
def classify_stream(spark, root):
    """Part names arriving as 8 files, classified micro-batch by micro-batch."""
    from ..streaming.classify_stream import read_stream_output
    base = work_dir(spark, "stream")
    _stream_job(spark, root, base)
    return read_stream_output(spark, f"{base}/out").select(*acsv.EXPORT_COLUMNS)


@query("stream_progress")
def stream_progress(spark, root):
    """Rows read and written per micro-batch of the incremental job (rows-only check)."""
    from ..streaming.classify_stream import job_progress
    base = work_dir(spark, "stream")
    _stream_job(spark, root, base)
    return job_progress(spark, f"{base}/out").select("batch_id", "input_rows", "output_rows", "state")


# ----------------------------------------------------------------- extras


def part_evaluation(spark, root) -> DataFrame:
    return evaluation_rows(coded_parts(spark, root))


@query("hier_accuracy")
def hier_accuracy(spark, root):
    return ex.hierarchical_accuracy(part_evaluation(spark, root), nomenclature_docs(spark, root))


@query("error_class")
def error_class_q(spark, root):
    return ex.error_class(part_evaluation(spark, root), nomenclature_docs(spark, root))


@query("sector_accuracy")
def sector_accuracy_q(spark, root):
    return ex.sector_accuracy(part_evaluation(spark, root), nomenclature_docs(spark, root))


def opaque(code):
    """A code that tells nothing of its place in the hierarchy."""
    return F.when(F.col(code).isNotNull(), F.substring(F.md5(code), 1, 12))


@query("error_class_opaque")
def error_class_opaque(spark, root):
    """D2 on codes that are no prefixes of each other; of every seventh row the prediction is
    another leaf of its parent, of its type, or a code that the nomenclature lacks."""
    docs = nomenclature_docs(spark, root)
    near = _leaf_filter(docs).groupBy("parent_code").agg(F.min("code").alias("first"))
    far = _leaf_filter(docs).agg(F.max("code").alias("last"))
    kind = F.col("query_id") % 7
    leaf = table(spark, root, "part").select(
        F.col("p_partkey").alias("query_id"), F.col("p_type").alias("sector"),
        F.concat_ws(".", "p_type", "p_brand", F.col("p_size").cast("string"),
                    F.col("p_partkey").cast("string")).alias("true_code"),
        F.concat_ws(".", "p_type", "p_brand", F.col("p_size").cast("string")).alias("parent_code"),
        F.concat_ws(".", "p_type", "p_brand").alias("group_code"))
    top = leaf.groupBy("sector").agg(F.min("true_code").alias("in_sector"))
    group = leaf.groupBy("group_code").agg(F.min("true_code").alias("in_group"))
    e = leaf.join(near, "parent_code").join(top, "sector").join(group, "group_code").select(
        "query_id", "true_code",
        F.when(kind == 0, F.col("first")).when(kind == 1, F.col("in_group")).when(kind == 2, F.col("in_sector"))
        .when(kind == 3, far.scalar()).when(kind == 4, F.lit("unknown")).when(kind == 5, F.col("true_code"))
        .alias("pred_code"))
    hidden = docs.select(opaque("code").alias("code"), "level", opaque("parent_code").alias("parent_code"))
    return ex.error_class(e.select("query_id", opaque("true_code").alias("true_code"),
                                   opaque("pred_code").alias("pred_code")), hidden)


@query("bootstrap_ci")
def bootstrap_ci(spark, root):
    return ex.bootstrap_accuracy(part_evaluation(spark, root), "query_id", 200, seed=SEED)


@query("prf")
def prf(spark, root):
    return ex.precision_recall_f1(loo_evaluation(spark, root))


@query("triage")
def triage_q(spark, root):
    d = ex.triage(loo_decisions(spark, root), 0.5)
    return d.select("query_id", "pred_code", "confidence", "queue")


def _bm25_ranks(spark, root, k: int) -> DataFrame:
    leaves = _leaf_filter(nomenclature_docs(spark, root)).select("code", "text")
    q = table(spark, root, "part").select("p_partkey", "p_name")
    return ex.bm25_topk(q, leaves, k, query_id="p_partkey", query_text="p_name", doc_id="code",
                        doc_text="text")


def _dense_ranks(spark, root, k: int) -> DataFrame:
    q = table(spark, root, "part").select("p_partkey", "p_name")
    qv = embed(q, "p_name", dim=EMBED_DIM, id_col="p_partkey")
    return knn_join(qv, leaf_vectors(spark, root), k, query_id="p_partkey", query_vec="vector",
                    corpus_id="code", corpus_vec="vector", dim=EMBED_DIM
                    ).withColumnRenamed("id", "code")


@query("bm25_top10")
def bm25_top10(spark, root):
    r = _bm25_ranks(spark, root, 10)
    return r.select("query_id", "rank", "code", F.round("score", 6).alias("score"))


@query("bm25_postings")
def bm25_postings(spark, root):
    """Postings that a search in the stored index reads, against all postings of the queries' terms (rows-only check)."""
    leaves = _leaf_filter(nomenclature_docs(spark, root)).select("code", "text")
    path = work_dir(spark, "postings")
    ex.bm25_index(leaves, path, doc_id="code", doc_text="text")
    return ex.bm25_report(table(spark, root, "part").select("p_partkey", "p_name"), path, 10, query_id="p_partkey", query_text="p_name")


@query("bm25_rrf")
def bm25_rrf(spark, root):
    """BM25 and dense rankings (10 each) fused by reciprocal rank."""
    return ex.reciprocal_rank_fusion(_bm25_ranks(spark, root, 10), _dense_ranks(spark, root, 10),
                                     k=5)


@query("rescore")
def rescore(spark, root):
    """Retrieve 10 neighbours, rescore by code vote, keep 5."""
    e = vectors(spark, root)
    c = knn_join(e, e, 10, query_id="vec_id", query_vec="embedding", corpus_id="vec_id",
                 corpus_vec="embedding", exclude_self=True, carry=["code"])
    return ex.vote_rescore(c, 5)


@query("few_shot")
def few_shot(spark, root):
    """The 3 most similar other labelled names as examples for each prompt."""
    q = table(spark, root, "part").select(
        "p_partkey", "p_name",
        F.concat_ws(".", "p_type", "p_brand", F.col("p_size").cast("string"),
                    F.col("p_partkey").cast("string")).alias("code"))
    qv = embed(q, "p_name", dim=EMBED_DIM, id_col="p_partkey")
    lists = knn_join(qv, qv, 3, query_id="p_partkey", query_vec="vector", corpus_id="p_partkey",
                     corpus_vec="vector", exclude_self=True, carry=["p_name", "code"],
                     as_lists=True, keep_empty=True)
    ex_text = F.transform(F.arrays_zip("p_names", "codes"),
                          lambda z: F.concat(z["p_names"], F.lit(" -> "), z["codes"]))
    return lists.select("query_id", F.size("codes").alias("n_examples"),
                        F.array_join(ex_text, "\n").alias("examples"))


@query("hier_check")
def hier_check(spark, root):
    return ex.hierarchy_violations(nomenclature_docs(spark, root))


@query("hier_check_faulty")
def hier_check_faulty(spark, root):
    """D10 where every fifth leaf names a parent that does not exist, and every next one its type."""
    docs = nomenclature_docs(spark, root)
    leaf = F.col("level") == 4
    key = F.element_at(F.split("code", "\\."), -1).try_cast("int") % 5
    parent = (F.when(leaf & (key == 0), "nowhere")
              .when(leaf & (key == 1), F.element_at(F.split("code", "\\."), 1)).otherwise(F.col("parent_code")))
    return ex.hierarchy_violations(docs.withColumn("parent_code", parent))


@query("vector_check_faulty")
def vector_check_faulty(spark, root):
    """D11 where every tenth vector is null, every next one short, with a NaN, or zero."""
    k, v = F.col("vec_id") % 10, F.col("embedding").cast("array<double>")
    bad = (F.when(k == 1, F.slice(v, 1, 8)).when(k == 2, F.concat(F.slice(v, 1, 63), F.array(F.lit(float("nan")))))
           .when(k == 3, F.transform(v, lambda x: F.lit(0.0))).when(k != 0, v))
    return ex.vector_checks(table(spark, root, "embeddings").select(bad.alias("embedding")), "embedding", 64)


@query("vector_check")
def vector_check(spark, root):
    return ex.vector_checks(table(spark, root, "embeddings"), "embedding", 64)


@query("resume")
def resume(spark, root):
    """The batch job run twice on the same output folder; the second run
    finds every id done and adds nothing."""
    from ..operators.knn import prepare_corpus
    out_dir = work_dir(spark, "resume")
    leaves = leaf_vectors(spark, root)
    prepared = prepare_corpus(leaves, corpus_id="code", corpus_vec="vector", carry=["code"],
                              dim=EMBED_DIM)                 # shared by both runs
    labels = nomenclature_labels(spark, root).persist()

    def job(rows):
        return (cls.classify_retrieval(rows, leaves, labels, prepared=prepared)
                .select(*acsv.EXPORT_COLUMNS))

    rows = part_activity_rows(spark, root)
    try:
        ex.resume_classification(spark, rows, out_dir, job)
        out = ex.resume_classification(spark, rows, out_dir, job)
        out.count()
    finally:
        if prepared is not None:
            prepared.release()
        labels.unpersist()
    return out

"""Static guards for the design rules of the package."""

import importlib
import pathlib
import re

PKG = pathlib.Path(__file__).resolve().parents[1] / "textcoder"
SOURCES = {p: p.read_text() for p in PKG.rglob("*.py") if p.relative_to(PKG).parts[0] != "llm"}

# Queries checked by invariants only: model training, approximate search,
# streaming progress and file listings have no SQL equivalent.
ROWS_ONLY = {"knn_cells", "cells_recall", "index_pairs", "knn_graph", "graph_recall", "bm25_postings", "table_exists", "subword_vocab", "subword_encode",
             "vocab_join", "train_predict", "predict_topk", "test_accuracy", "token_attrib",
             "word_attrib", "char_attrib", "classify_batch_supervised", "model_round_trip", "run_log", "stream_progress"}


def test_every_query_has_an_oracle_or_is_declared_rows_only():
    entry = importlib.import_module("__spark_entry__")
    optional = set(entry.LLM_QUERIES)
    q, o = set(entry.queries()) - optional, set(entry.oracle_sql()) - optional
    assert q - o == ROWS_ONLY
    assert o <= q


def test_no_cross_join_no_local_checkpoint():
    for path, src in SOURCES.items():
        assert "crossJoin" not in src, path
        assert "localCheckpoint" not in src, path


def test_limits_only_where_they_are_the_feature():
    allowed = {"sample", "head_n", "preview_100", "preview", "value_counts",
               "_collect_corpus", "build_index", "_calibrated", "_scan", "_scored", "train_vocabulary", "detect_delimiter", "read_activity_csv"}
    for path, src in SOURCES.items():
        for m in re.finditer(r"\.limit\(", src):
            fn = re.findall(r"^def (\w+)", src[:m.start()], re.M)
            if not fn:          # module docstring text, not code
                continue
            assert fn[-1] in allowed, f"{path}: limit in {fn[-1]}"


def test_no_rows_through_python_rdds():
    for path, src in SOURCES.items():
        for m in re.finditer(r"\.rdd\.(\w+)", src):
            assert m.group(1) == "getNumPartitions", f"{path}: .rdd.{m.group(1)}"

"""The stored cell index against brute force: exact search with bounds, probes, both plans, odd vectors."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textcoder.operators import cell_index as ci
from textcoder.operators.knn import knn_join

DIM = 8


def _clustered(n, seed, spread=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, DIM)) * 3
    which = rng.integers(0, 12, n)
    which[: n // 3] = 0                                     # a hot cell
    return [(int(i), [float(v) for v in centres[c] + spread * rng.normal(size=DIM)], f"c{i % 7}") for i, c in enumerate(which)]


@pytest.fixture(scope="module")
def data(spark):
    corpus = spark.createDataFrame(_clustered(600, 1), "id long, vector array<double>, code string")
    queries = spark.createDataFrame([(10_000 + i, v, c) for i, v, c in _clustered(90, 2)], "id long, vector array<double>, code string")
    return corpus, queries


def _rows(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.score, 6)) for r in df.collect())


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot"])
def test_exact_search_equals_brute_force_and_drops_cells(spark, data, tmp_path, metric):
    corpus, queries = data
    index = ci.build_index(corpus, str(tmp_path / "ix"), carry=["code"], metric=metric, n_cells=12, nprobe=1)
    expected = _rows(knn_join(queries, corpus, 4, metric=metric, carry=["code"], strategy="broadcast"))
    for strategy in ("broadcast", "blocks"):
        found = ci.search(index, queries, 4, exact=True, strategy=strategy, first=1)
        assert found.columns == ["query_id", "rank", "id", "score", "code"]
        assert _rows(found) == expected
    report = ci.search_report(index, queries, 4, exact=True, first=1).first()
    assert report.queries == 90 and report.rows == 600 and report.pairs == 54_000
    if metric != "dot":
        assert report.pairs_scored < 0.6 * report.pairs


def test_a_stored_index_is_opened_and_probed_again(spark, data, tmp_path):
    corpus, queries = data
    built = ci.build_index(corpus, str(tmp_path / "ix"), n_cells=12, sample_rows=200)
    index = ci.open_index(spark, str(tmp_path / "ix"))
    assert index.nprobe == built.nprobe < 12 and index.rows == 600 and index.sizes.sum() == 600
    exact = {x[::2] for x in _rows(knn_join(queries, corpus, 5))}
    for strategy in ("broadcast", "blocks"):
        found = {x[::2] for x in _rows(ci.search(index, queries, 5, strategy=strategy))}
        assert len(found & exact) >= 0.9 * len(exact)
    assert _rows(ci.search(index, queries, 5, nprobe=99)) == _rows(knn_join(queries, corpus, 5))
    # Only the probed cells are read.
    one = queries.limit(1)
    plan = ci.search(index, one, 3, nprobe=1)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*cell#\d+ = \d", plan)
    lists = ci.search(index, queries, 3, as_lists=True).collect()
    assert all(len(r.ids) == len(r.scores) == 3 for r in lists)
    with pytest.raises(Exception, match="meta"):
        ci.open_index(spark, str(tmp_path / "nothing"))


def test_blocks_of_queries_and_rows(spark, data, tmp_path, monkeypatch):
    """Cells larger than a tile, and more queries than a block holds, give the same result."""
    corpus, queries = data
    monkeypatch.setattr(ci, "CORPUS_BLOCK", 16)
    monkeypatch.setattr(ci, "QUERY_BLOCK", 7)
    index = ci.build_index(corpus, str(tmp_path / "ix"), n_cells=5, nprobe=2)
    assert spark.read.parquet(str(tmp_path / "ix" / "vectors")).select("cell", "sub").distinct().count() > 30
    assert _rows(ci.search(index, queries, 5, strategy="blocks")) == _rows(ci.search(index, queries, 5, strategy="broadcast"))
    plan = ci._scan_blocks(spark, ci._ask(queries.select(F.col("id").alias("_qid"), F.col("vector").alias("_qv")), index, ci._nearest(index, 1)),
                           index, ci.KnnSpec(3, "cosine"))._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_odd_vectors_are_rejected_or_have_no_neighbours(spark, tmp_path):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0]), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [1.0, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    index = ci.build_index(df, str(tmp_path / "ix"))
    rejects = {r["_cid"]: r.why for r in spark.read.parquet(str(tmp_path / "ix" / "rejects")).collect()}
    assert rejects == {3: "null vector", 4: "wrong dimension", 5: "no direction", 6: "value missing", 8: "value missing"}
    found = _rows(ci.search(index, df, 2, exact=True, exclude_self=True))
    assert {x[0] for x in found} == {1, 2, 7, 9}
    assert [x[2] for x in found if x[0] == 1] == [9, 7] and [x[2] for x in found if x[0] == 2] == [7, 1]      # a tie goes to the smaller id
    empty = ci.build_index(df.limit(0), str(tmp_path / "empty"))
    assert empty.rows == 0 and ci.search(empty, df, 2).collect() == [] and ci.search(empty, df, 2, exact=True).collect() == []
    assert ci.search(index, df.limit(0), 2).collect() == []
    with pytest.raises(ValueError, match="metric"):
        ci.build_index(df, str(tmp_path / "x"), metric="hamming")


def test_recall_of_vectors_without_clusters(spark):
    from textcoder.plans.catalog import REGISTRY
    assert REGISTRY["cells_recall"](spark, "/root/testdata/sf0.01").first().recall >= 0.9


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot"])
def test_queries_are_sent_once_per_group_of_cells(spark, tmp_path, monkeypatch, metric):
    """Many cells make one group: a query has ``k`` candidates, not ``k`` per cell; several groups give the same neighbours, ties by key."""
    rng = np.random.default_rng(7)
    rows = [(int(i), [float(v) for v in rng.integers(-2, 3, 4)]) for i in range(700)]                  # many equal scores
    rows = [(i, v if any(v) else [1.0, 0.0, 0.0, 0.0]) for i, v in rows]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    index = ci.build_index(df, str(tmp_path / "ix"), metric=metric, n_cells=9, nprobe=9)
    expected = _rows(knn_join(df, df, 4, metric=metric, exclude_self=True, strategy="broadcast"))
    asked = ci._ask(df.select(F.col("id").alias("_qid"), F.col("vector").alias("_qv")), index, ci._nearest(index, 9)).checkpoint()
    assert ci._scan_blocks(spark, asked, index, ci.KnnSpec(4, metric, True)).count() == 4 * 700
    assert _rows(ci.search(index, df, 4, exclude_self=True, strategy="blocks")) == expected
    monkeypatch.setattr(ci, "CORPUS_BLOCK", 40)
    monkeypatch.setattr(ci, "QUERY_BLOCK", 100)
    monkeypatch.setattr(ci, "GROUP_ROWS", 150)
    index = ci.build_index(df, str(tmp_path / "parts"), metric=metric, n_cells=9, nprobe=9)
    _, spans = ci._packed(index.sizes, index.sizes, index.dim)
    assert len(spans) >= 4
    assert _rows(ci.search(index, df, 4, exclude_self=True, strategy="blocks")) == expected
    assert _rows(ci.search(index, df, 4, exclude_self=True, exact=True, strategy="blocks")) == expected

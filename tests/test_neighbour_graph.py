"""Neighbour-graph refinement against brute force."""

import numpy as np
import pytest

from textcoder.operators import neighbour_graph as ng
from textcoder.operators.knn import knn_join


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_graph_finds_neighbours_with_fewer_distances(spark, metric):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(v) for v in rng.normal(size=6)]) for i in range(1200)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    graph = ng.build_graph(df, degree=10, metric=metric)
    exact = {(r.query_id, r.id): round(r.score, 9) for r in knn_join(df, df, 4, metric=metric, exclude_self=True).collect()}
    found = {(r.query_id, r.id): round(r.score, 9) for r in ng.neighbours(graph, 4).collect()}
    both = found.keys() & exact.keys()
    assert len(both) >= 0.9 * len(exact) and all(found[p] == exact[p] for p in both)
    assert graph.rows == 1200 and graph.all_pairs == 719_400 and graph.distances < 0.5 * graph.all_pairs
    assert graph.links.groupBy("node").count().agg({"count": "max"}).first()[0] == 10


def test_odd_rows(spark):
    rows = [("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", None), ("d", [0.0, 0.0]), ("e", [1.0]), (None, [1.0, 1.0]), ("f", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id string, vector array<double>")
    graph = ng.build_graph(df, degree=4)
    assert [(r.query_id, r["rank"], r.id) for r in ng.neighbours(graph, 1).orderBy("query_id").collect()] == [("a", 1, "b"), ("b", 1, "a"), ("f", 1, "b")]
    assert ng.neighbours(ng.build_graph(df.limit(0))).collect() == []
    assert ng.neighbours(ng.build_graph(df.where("id = 'a'"))).collect() == []
    with pytest.raises(ValueError, match="metric"):
        ng.build_graph(df, metric="x")


def test_recall_of_vectors_without_clusters(spark):
    from textcoder.plans.catalog import REGISTRY
    row = REGISTRY["graph_recall"](spark, "/root/testdata/sf0.1").first()
    assert row.recall >= 0.9 and row.distances < row.all_pairs


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot"])
def test_vectors_are_copied_per_block_not_per_pair(spark, monkeypatch, metric):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 5))
    vectors = spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in enumerate(x)], "node long, vec array<double>").checkpoint()
    asked = [(i, j) for i in range(60) for j in range(i + 1, 60, 3)]
    pairs = spark.createDataFrame(asked, "a long, b long").checkpoint()
    monkeypatch.setattr(ng, "BLOCK_ROWS", 25)
    monkeypatch.setattr(ng, "PAIR_ROWS", 40)
    want = {}
    for i, j in asked:
        dot = float(x[i] @ x[j])
        want[i, j] = {"cosine": float(dot / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j]))), "l2": float(np.linalg.norm(x[i] - x[j])), "dot": dot}[metric]
    want.update({(j, i): score for (i, j), score in want.items()})
    scored = ng._scored(pairs, vectors, metric, 60, len(asked), 5, 60)
    assert "Join" not in scored._jdf.queryExecution().executedPlan().toString()
    got = {(r.node, r.nb): r.score for r in scored.collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in got)
    # Only what may enter the best two of a row, which its links so far and the other pairs of a group decide.
    sign = -1 if metric == "l2" else 1
    best = {(i, j) for i in range(60) for j in sorted((j for k, j in want if k == i), key=lambda j: (-sign * round(want[i, j], 6), j))[:2]}
    links = spark.createDataFrame([(i, j, want[i, j]) for i, j in sorted(best)], "node long, nb long, score double").checkpoint()
    for graph in (None, links):
        found = {(r.node, r.nb) for r in ng._scored(pairs, vectors, metric, 60, len(asked), 5, 2, graph).collect()}
        assert best <= found and len(found) < len(want)
    assert found == best

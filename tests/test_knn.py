import numpy as np
import pytest
from pyspark.sql import functions as F

from textcoder.operators.knn import knn_cells, knn_join
from textcoder.operators.retrieval import retrieve_and_decide


def _vectors(spark, n, dim, seed):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, dim))
    return spark.createDataFrame([(i, [float(x) for x in m[i]], str(i % 3)) for i in range(n)],
                                 "id long, vector array<double>, code string"), m


def _brute(q, c, k, exclude_self=False):
    qn = q / np.linalg.norm(q, axis=1)[:, None]
    cn = c / np.linalg.norm(c, axis=1)[:, None]
    s = np.round(qn @ cn.T, 6)
    out = []
    for i in range(len(q)):
        order = sorted((j for j in range(len(c)) if not (exclude_self and i == j)),
                       key=lambda j: (-s[i, j], j))[:k]
        out += [(i, r + 1, j) for r, j in enumerate(order)]
    return out


@pytest.mark.parametrize("strategy", ["broadcast", "blocks"])
def test_exact_matches_brute_force(spark, strategy):
    df, m = _vectors(spark, 60, 8, 1)
    r = knn_join(df, df, 4, exclude_self=True, strategy=strategy)
    got = sorted((a, b, c) for a, b, c, _ in r.collect())
    assert got == sorted(_brute(m, m, 4, exclude_self=True))


def test_ties_break_by_key_and_k_larger_than_corpus(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "id long, vector array<double>")
    c = spark.createDataFrame([(10, [2.0, 0.0], "b"), (11, [1.0, 0.0], "a"), (12, [0.0, 1.0], "c")],
                              "id long, vector array<double>, code string")
    r = knn_join(q, c, 10, key="code").orderBy("rank").collect()
    assert [x["id"] for x in r] == [11, 10, 12]      # identical scores: code a before b
    assert len(r) == 3


def test_empty_corpus_gives_no_candidate_decision(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "id long, vector array<double>")
    c = spark.createDataFrame([], "id long, vector array<double>, code string")
    d = retrieve_and_decide(q, c, 5, query_id="id", query_vec="vector", corpus_id="id",
                            corpus_vec="vector").first()
    assert d["pred_code"] is None and d["codable"] is False and d["confidence"] == 0.0
    assert d["retrieved_codes"] == []


def test_list_form_equals_long_form(spark):
    df, _ = _vectors(spark, 40, 6, 2)
    long = {(r["query_id"], r["rank"], r["id"]) for r in knn_join(df, df, 3).collect()}
    lists = knn_join(df, df, 3, as_lists=True, carry=["code"]).collect()
    flat = {(r["query_id"], i + 1, x) for r in lists for i, x in enumerate(r["ids"])}
    assert long == flat
    assert all(len(r["codes"]) == len(r["ids"]) for r in lists)


def test_all_cells_equal_exact(spark):
    df, _ = _vectors(spark, 80, 5, 3)
    exact = {tuple(r[:3]) for r in knn_join(df, df, 3, exclude_self=True).collect()}
    cells = {tuple(r[:3]) for r in knn_cells(df, df, 3, n_cells=6, nprobe=6,
                                             exclude_self=True).collect()}
    assert exact == cells


def test_metrics_dot_and_l2(spark):
    q = spark.createDataFrame([(1, [1.0, 1.0])], "id long, vector array<double>")
    c = spark.createDataFrame([(1, [3.0, 0.0]), (2, [1.0, 1.0]), (3, [-1.0, 0.0])],
                              "id long, vector array<double>")
    dot = [r["id"] for r in knn_join(q, c, 3, metric="dot").orderBy("rank").collect()]
    l2 = [r["id"] for r in knn_join(q, c, 3, metric="l2").orderBy("rank").collect()]
    assert dot == [1, 2, 3] and l2 == [2, 1, 3]


def test_cells_bounded_by_centroid_bytes_stay_exact_with_all_probes(spark):
    df, _ = _vectors(spark, 50, 4, 5)
    exact = {tuple(r[:3]) for r in knn_join(df, df, 3).collect()}
    # 8 bytes x 4 dims x 3 = room for 3 centroids only
    cells = knn_cells(df, df, 3, n_cells=10, nprobe=10, max_centroid_bytes=8 * 4 * 3)
    assert {tuple(r[:3]) for r in cells.collect()} == exact


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_sparse_queries_match_brute_force(spark, metric):
    rng = np.random.default_rng(7)
    dim = 40
    q = np.zeros((30, dim))
    for i in range(30):
        q[i, rng.choice(dim, 3, replace=False)] = rng.random(3) + 0.1
    c = rng.random((50, dim))
    qdf = spark.createDataFrame([(i, [float(x) for x in q[i]]) for i in range(30)],
                                "id long, vector array<double>")
    cdf = spark.createDataFrame([(j, [float(x) for x in c[j]]) for j in range(50)],
                                "id long, vector array<double>")
    got = sorted((a, b, d) for a, b, d, _ in knn_join(qdf, cdf, 4, metric=metric).collect())
    if metric == "cosine":
        s = (q / np.linalg.norm(q, axis=1)[:, None]) @ (c / np.linalg.norm(c, axis=1)[:, None]).T
    elif metric == "dot":
        s = q @ c.T
    else:
        s = -np.sqrt(((q[:, None, :] - c[None, :, :]) ** 2).sum(-1))
    s = np.round(s, 6)
    want = sorted((i, r + 1, j) for i in range(30)
                  for r, j in enumerate(sorted(range(50), key=lambda j: (-s[i, j], j))[:4]))
    assert got == want


def test_prepared_corpus_reused(spark):
    from textcoder.operators.knn import prepare_corpus
    df, _ = _vectors(spark, 40, 6, 11)
    plain = {tuple(r[:3]) for r in knn_join(df, df, 3, carry=["code"]).collect()}
    prep = prepare_corpus(df, carry=["code"])
    for _ in range(2):
        again = {tuple(r[:3]) for r in knn_join(df, df, 3, carry=["code"], prepared=prep).collect()}
        assert again == plain
    prep.release()


def _sparse(spark, n, dim, seed):
    rng = np.random.default_rng(seed)
    m = np.zeros((n, dim))
    for i in range(n):
        m[i, rng.integers(0, dim, 3)] = rng.integers(1, 3, 3)
    m[n // 2:] = m[:n - n // 2]                       # equal vectors under other ids
    return spark.createDataFrame([(i, m[i].tolist(), f"c{i:03d}") for i in range(n)], "id long, vector array<double>, code string"), m


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot"])
def test_block_plan_searches_equal_sparse_queries_once_and_equals_broadcast(spark, monkeypatch, metric):
    from textcoder.operators import knn
    monkeypatch.setattr(knn, "GROUP_ROWS", 16)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 16)
    monkeypatch.setattr(knn, "CORPUS_BLOCK", 16)
    df, _ = _sparse(spark, 90, 40, 5)
    kw = dict(exclude_self=True, carry=["code"], as_lists=True, keep_empty=True, query_carry=["code"], metric=metric)
    lists = {s: {r["query_id"]: (r["code"], r["ids"], r["codes"], np.round(r["scores"], 6).tolist()) for r in
                 knn_join(df, df, 4, strategy=s, **kw).collect()} for s in ("blocks", "broadcast")}
    assert len(lists["blocks"]) == 90 and lists["blocks"] == lists["broadcast"]


def test_groups_of_the_block_plan_grow_with_memory_not_with_the_input():
    from textcoder.operators import knn
    assert knn._group_rows(12 * 64 + 64, knn.CORPUS_BLOCK) * (12 * 64 + 64) <= knn.GROUP_BYTES
    assert knn._group_rows(100, knn.CORPUS_BLOCK) == knn.GROUP_ROWS         # 16 times fewer copies of the other side than blocks of 4,096


def test_a_corpus_over_the_bound_is_counted_not_collected(spark, monkeypatch):
    rows = [(i, [float(i % 7), 1.0, 0.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    want = sorted(map(tuple, knn_join(df, df, 3).collect()))

    def refused(self):
        raise AssertionError("collected")
    monkeypatch.setattr(type(df), "toArrow", refused)
    assert sorted(map(tuple, knn_join(df, df, 3, broadcast_max_bytes=8 * 60).collect())) == want
    monkeypatch.setattr("textcoder.operators.knn.LISTS_MAX_BYTES", 100)
    assert sorted(map(tuple, knn_join(df, df, 3).collect())) == want


def test_a_broadcast_corpus_is_held_as_lists_of_its_entries(spark):
    from textcoder.operators.knn import prepare_corpus
    rows = [(i, [0.0] * i + [1.0] + [0.0] * (999 - i)) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    prep = prepare_corpus(df)
    held = prep.bc.value[3]
    assert prep.rows == 100 and prep.dim == 1000 and held.values.nbytes == 800
    got = knn_join(df, df, 1, prepared=prep).collect()
    assert sorted((r["query_id"], r["id"]) for r in got) == [(i, i) for i in range(100)]

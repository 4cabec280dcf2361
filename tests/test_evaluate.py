import numpy as np

from textcoder.operators import evaluate as ev


def _rows(spark, rows):
    return ev.evaluation_columns(spark.createDataFrame(
        rows, "id int, true_code string, pred_code string, confidence double, "
              "retrieved_codes array<string>"))


def test_flags_and_metrics(spark):
    e = _rows(spark, [
        (1, "a", "a", 0.9, ["a", "b"]),      # hit + correct
        (2, "a", "b", 0.8, ["b", "a"]),      # hit + wrong
        (3, "a", "c", 0.2, ["c"]),           # miss
        (4, "b", None, 0.0, []),             # null prediction
        (5, "d", "d", 0.95, ["x"]),          # correct but not retrieved
    ])
    f = {r["id"]: r for r in e.collect()}
    assert f[1]["retriever_hit"] and f[1]["correct"] and f[1]["correct_given_hit"]
    assert f[2]["retriever_hit"] and not f[2]["correct"] and f[2]["correct_given_hit"] is False
    assert not f[3]["retriever_hit"] and f[3]["correct_given_hit"] is None
    assert f[4]["correct"] is False
    m = {r["metric"]: r["value"] for r in ev.rag_metrics(e).collect()}
    assert m["n_total"] == 5 and m["n_hit"] == 2 and m["n_correct"] == 2
    assert m["retriever_at_k"] == 0.4 and m["conditional_accuracy"] == 0.5
    assert m["pipeline_accuracy"] == 0.4 and m["correct_not_retrieved"] == 1
    split = {r["stage"]: r["n"] for r in ev.error_split(e).collect()}
    assert split == {"retriever_error": 3, "generation_error": 1, "correct": 2}


def test_no_hits_conditional_is_null(spark):
    e = _rows(spark, [(1, "a", "b", 0.5, ["b"])])
    m = {r["metric"]: r["value"] for r in ev.rag_metrics(e).collect()}
    assert m["conditional_accuracy"] is None


def test_precision_coverage_omits_empty_thresholds(spark):
    e = _rows(spark, [(1, "a", "a", 0.35, ["a"]), (2, "a", "b", 0.15, ["b"])])
    c = ev.precision_coverage(e).collect()
    ts = sorted({r["threshold"] for r in c})
    assert ts == [0.1, 0.2, 0.3]
    v = {(r["threshold"], r["metric"]): r["value"] for r in c}
    assert v[(0.1, "precision")] == 0.5 and v[(0.2, "precision")] == 1.0
    assert v[(0.3, "coverage")] == 0.5


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(0)
    vals = rng.random(301)
    df = spark.createDataFrame([("g" if i % 3 else "h", float(v)) for i, v in enumerate(vals)],
                               "g string, v double")
    q = {(r["g"], r["p"]): r["q"] for r in ev.exact_quantiles(df, "g", "v", (0.25, 0.5, 0.75)).collect()}
    for g, sel in (("g", [v for i, v in enumerate(vals) if i % 3]),
                   ("h", [v for i, v in enumerate(vals) if not i % 3])):
        for p in (0.25, 0.5, 0.75):
            assert abs(q[(g, p)] - np.percentile(sel, p * 100)) < 1e-12


def test_distinct_values_of_an_empty_table(spark):
    from textcoder.operators.evaluate import n_unique
    df = spark.createDataFrame([(None,), ("a",), ("a",)], "x string")
    assert n_unique(df.limit(0), "x").first()[:] == (0, 0) and n_unique(df, "x").first()[:] == (3, 2)

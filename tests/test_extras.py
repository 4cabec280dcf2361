import math

from pyspark.sql import functions as F

from textcoder.operators import extras as ex


def _ev(spark, rows):
    return spark.createDataFrame(rows, "query_id int, true_code string, pred_code string")


def test_hierarchy_accuracy_and_error_classes(spark):
    # A letter above numbers: an ancestor's code is no prefix.
    n = spark.createDataFrame(
        [("A", 1, None), ("03", 2, "A"), ("03.1", 3, "03"), ("03.2", 3, "03"), ("03.11", 4, "03.1"), ("03.12", 4, "03.1"),
         ("03.21", 4, "03.2"), ("01", 2, "A"), ("01.1", 3, "01"), ("01.11", 4, "01.1"), ("B", 1, None), ("05", 2, "B"),
         ("05.1", 3, "05"), ("05.11", 4, "05.1")], "code string, level int, parent_code string")
    e = _ev(spark, [(1, "03.11", "03.11"), (2, "03.11", "03.12"), (3, "03.11", "03.21"), (4, "03.11", "01.11"),
                    (5, "03.11", "05.11"), (6, "03.11", None), (7, "03.11", "99.99"), (8, "77", "77")])
    acc = {r["depth"]: r["n_correct"] for r in ex.hierarchical_accuracy(e, n).collect()}
    assert acc == {1: 5, 2: 4, 3: 3, 4: 2}
    cls = {r["error_class"]: r["n"] for r in ex.error_class(e, n).collect()}
    assert cls == {"exact": 2, "sibling": 1, "same_group": 1, "same_sector": 1, "far": 2, "none": 1}
    sec = {r["sector"]: (r["n"], r["n_correct"]) for r in ex.sector_accuracy(e, n).collect()}
    assert sec == {"A": (7, 1), None: (1, 1)}


def test_bm25_is_over_terms_and_leaves_out_unrelated_documents(spark):
    docs = [("d1", "apple pie, apple"), ("d2", "pear tart"), ("d3", "apple tart tart"), ("d4", None), ("d5", "")]
    d = spark.createDataFrame(docs, "code string, text string")
    q = spark.createDataFrame([(1, "Apple"), (2, "tart apple apple"), (3, "nothing"), (4, None)], "q int, t string")
    got = {}
    for r in ex.bm25_topk(q, d, 3, query_id="q", query_text="t", doc_id="code", doc_text="text").orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["code"], round(r["score"], 6)))
    words = {c: (t or "").replace(",", "").split() for c, t in docs}
    avgdl = sum(map(len, words.values())) / len(docs)

    def score(query, doc):
        total = 0.0
        for t in query:
            df, tf = sum(t in w for w in words.values()), words[doc].count(t)
            total += (math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2
                      / (tf + 1.2 * (0.25 + 0.75 * len(words[doc]) / avgdl)))
        return round(total, 6)

    for i, query in {1: ["apple"], 2: ["tart", "apple", "apple"]}.items():
        want = sorted(((c, score(query, c)) for c in words if score(query, c) > 0), key=lambda x: (-x[1], x[0]))
        assert got[i] == want[:3]
    assert set(got) == {1, 2}


def test_prf_counts_and_unpredicted_class(spark):
    e = _ev(spark, [(1, "a", "a"), (2, "a", "b"), (3, "b", "b"), (4, "c", "b")])
    r = {x["class"]: x for x in ex.precision_recall_f1(e).collect()}
    assert (r["a"]["tp"], r["a"]["fp"], r["a"]["fn"]) == (1, 0, 1)
    assert (r["b"]["tp"], r["b"]["fp"], r["b"]["fn"]) == (1, 2, 0)
    assert r["c"]["precision"] is None and r["c"]["recall"] == 0.0
    assert r["b"]["precision"] == round(1 / 3, 6)


def test_bootstrap_is_deterministic_and_brackets_estimate(spark):
    e = spark.range(0, 300).select(F.col("id").alias("query_id"),
                                   (F.col("id") % 3 == 0).alias("correct"))
    a = ex.bootstrap_accuracy(e, "query_id", 100, seed=7).first()
    b = ex.bootstrap_accuracy(e, "query_id", 100, seed=7).first()
    assert a == b and a["replicates"] == 100
    assert a["lower"] <= a["estimate"] <= a["upper"] and a["estimate"] == round(100 / 300, 6)


def test_vote_rescore_prefers_codes_with_more_support(spark):
    c = spark.createDataFrame([(1, 1, 10, "x", 0.9), (1, 2, 11, "y", 0.8), (1, 3, 12, "y", 0.7)],
                              "query_id int, rank int, id int, code string, score double")
    r = [x["id"] for x in ex.vote_rescore(c, 2).orderBy("rank").collect()]
    assert r == [11, 12]


def test_macro_f1_counts_classes_without_a_hit(spark):
    e = _ev(spark, [(1, "a", "a"), (2, "a", "a"), (3, "b", "a"), (4, "c", None)])
    r = {x["class"]: x for x in ex.precision_recall_f1(e).collect()}
    assert r["macro"]["f1"] == round(0.8 / 3, 6) and r["weighted"]["f1"] == 0.4


def test_bm25_of_empty_sides(spark):
    some = spark.createDataFrame([("a", "apple")], "code string, text string")
    none = some.where("false")
    kw = {"query_id": "code", "query_text": "text", "doc_id": "code", "doc_text": "text"}
    assert ex.bm25_topk(some, none, 3, **kw).collect() == ex.bm25_topk(none, some, 3, **kw).collect() == []


def test_bm25_bounds_lose_no_document(spark, tmp_path, monkeypatch):
    """Small blocks and parts of queries: the same ranks as scoring everything, with fewer postings read."""
    import math
    import random

    from textcoder.operators import extras as ex
    from textcoder.operators import postings
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(f"d{i:03}", " ".join(rng.choices(words, weights, k=rng.randrange(1, 12)))) for i in range(400)]
    asked = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(1, 6)))) for i in range(40)]
    monkeypatch.setattr(postings, "BLOCK", 50)
    d, q = spark.createDataFrame(docs, "code string, text string").coalesce(1), spark.createDataFrame(asked, "q int, t string")
    ex.bm25_index(d, str(tmp_path / "ix"), doc_id="code", doc_text="text")
    kw = dict(query_id="q", query_text="t")
    got = {}
    for r in ex.bm25_search(q, str(tmp_path / "ix"), 5, **kw).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.code, round(r.score, 6)))
    n, avg = len(docs), sum(len(t.split()) for _, t in docs) / len(docs)
    held = {w: sum(w in t.split() for _, t in docs) for w in words}
    for i, t in asked:
        scored = []
        for code, text in docs:
            own = text.split()
            s = sum(math.log(1 + (n - held[w] + 0.5) / (held[w] + 0.5)) * own.count(w) * (ex.BM25_K1 + 1)
                    / (own.count(w) + ex.BM25_K1 * (1 - ex.BM25_B + ex.BM25_B * len(own) / avg)) for w in t.split() if w in own)
            if s:
                scored.append((-round(s, 6), code))
        assert [(c, s) for _, c, s in sorted(got.get(i, []))] == [(c, -s) for s, c in sorted(scored)[:5]], t
    report = ex.bm25_report(q, str(tmp_path / "ix"), 5, **kw).first()
    assert 0 < report.postings_read < report.postings
    parts = postings.search_postings(spark, str(tmp_path / "ix"), q, 5, query_id="q", term_counts=lambda x: ex._term_counts(x, "q", "t"), max_bytes=500)
    assert {(r.query_id, r["rank"], r.code) for r in parts.collect()} == {(i, rank, c) for i, v in got.items() for rank, c, _ in v}

from textcoder.operators import extras as ex


def test_equal_queries_are_searched_once_and_each_gets_its_ranks(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", "red ring " * (1 + i % 3) + "bolt " * (i % 5)) for i in range(40)], "code string, text string")
    one = spark.createDataFrame([(0, "red bolt")], "id long, q string")
    many = spark.createDataFrame([(i, "red bolt" if i % 2 else "bolt  RED") for i in range(30)], "id long, q string")
    path = str(tmp_path / "postings")
    ex.bm25_index(docs, path, doc_id="code", doc_text="text")
    read = [ex.bm25_report(q, path, 3, query_id="id", query_text="q").first() for q in (one, many)]
    assert read[1]["postings_read"] == read[0]["postings_read"] and read[1]["postings"] == 30 * read[0]["postings"]
    ranks = [sorted((r["query_id"], r["rank"], r["code"], round(r["score"], 6)) for r in ex.bm25_topk(
        q, docs, 3, query_id="id", query_text="q", doc_id="code", doc_text="text").collect()) for q in (one, many)]
    assert ranks[1] == [(i, *r[1:]) for i in range(30) for r in ranks[0]]

import pyarrow as pa

from textcoder.operators import subword
from textcoder.operators.partitioning import slices


def test_slices_are_bounded_by_text_and_rows_and_keep_every_row():
    texts = ["x" * 10, None, "y" * 500, "", "z" * 40, "é" * 30, "w" * 60] + ["v"] * 20
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": texts})
    parts = list(slices(batch, "text", max_bytes=100, max_rows=6))
    assert [i for p in parts for i in p.column("id").to_pylist()] == list(range(len(texts)))
    for p in parts:
        size = sum(len((t or "").encode()) for t in p.column("text").to_pylist())
        assert p.num_rows == 1 or (size <= 100 and p.num_rows <= 6)
    assert list(slices(batch.slice(0, 0), "text")) == []


def test_encoding_in_slices_keeps_all_rows_and_pieces(spark):
    texts = spark.createDataFrame([(i, "one two three " * 50) for i in range(3000)], "doc_id long, label string")
    vocab = spark.createDataFrame(list(enumerate([subword.PAD, subword.UNK, "one", "two"])), "token_id int, token string")
    enc = subword.encode(texts, "label", vocab, max_len=4).collect()
    assert sorted(r["doc_id"] for r in enc) == list(range(3000)) and all(r["ids"] == [2, 3, 1, 2] for r in enc)
    assert all(len(r["pieces"]) == 150 for r in enc)


def test_encoding_takes_small_batches_even_if_it_runs_later(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    texts = spark.createDataFrame([(1, "one İ one_three"), (2, None), (3, "")], "doc_id long, label string")
    vocab = spark.createDataFrame([(7, subword.PAD), (5, subword.UNK), (3, "o"), (9, "##ne"), (4, "two")], "token_id int, token string")
    try:
        spark.conf.set(name, str(64 << 20))
        enc = {r["doc_id"]: r for r in subword.encode(texts, "label", vocab).collect()}
        assert int(spark.conf.get(name)) <= 2 << 20
    finally:
        spark.conf.set(name, before)
    assert [tuple(p) for p in enc[1]["pieces"]] == [(3, "o", 0, 1, 0), (9, "##ne", 1, 3, 0), (5, subword.UNK, 4, 5, 1), (3, "o", 6, 7, 2),
                                                    (9, "##ne", 7, 9, 2), (5, subword.UNK, 10, 15, 3)]
    assert enc[1]["ids"] == [3, 9, 5, 3, 9, 5] and enc[2]["pieces"] == [] == enc[3]["ids"]


def test_a_task_makes_no_object_per_piece():
    import regex
    place = {subword.PAD: 0, subword.UNK: 1, "ab": 2, "##c": 3}
    cache = {}
    counts, at, start, end, word = subword._encode_texts(["abc abx", None, "ab"], place, regex.compile(subword.WORD), cache, 4)
    assert counts.tolist() == [3, 0, 1] and at.tolist() == [2, 3, 1, 2] and start.tolist() == [0, 2, 4, 0]
    assert end.tolist() == [2, 3, 7, 2] and word.tolist() == [0, 0, 1, 0]
    assert all(isinstance(v, bytes) for v in cache.values()) and set(cache) == {"abc", "abx", "ab"}

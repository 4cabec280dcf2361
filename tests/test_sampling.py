from pyspark.sql import functions as F

from textcoder.operators import sampling


def test_split_sizes_like_two_step_split():
    assert sampling.split_sizes(1000, (0.7, 0.15, 0.15)) == [700, 150, 150]
    assert sampling.split_sizes(1, (0.7, 0.15, 0.15)) == [0, 0, 1]
    assert sum(sampling.split_sizes(977, (0.7, 0.15, 0.15))) == 977


def test_split_disjoint_complete_exact(spark):
    df = spark.range(0, 1234).withColumnRenamed("id", "key")
    s = sampling.split(df, "key")
    counts = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts == dict(zip(("train", "val", "test"), sampling.split_sizes(1234, (0.7, 0.15, 0.15))))
    assert s.select("key").distinct().count() == 1234
    again = {(r["key"], r["split"]) for r in sampling.split(df, "key").collect()}
    assert again == {(r["key"], r["split"]) for r in s.collect()}


def test_kth_smallest_matches_sort(spark):
    df = spark.range(0, 500).withColumn("h", sampling.order_hash("id"))
    hs = sorted(r["h"] for r in df.collect())
    got = sampling.kth_smallest(df, "h", [1, 250, 500])
    assert got == {1: hs[0], 250: hs[249], 500: hs[499]}


def test_sample_is_deterministic(spark):
    df = spark.range(0, 300)
    a = [r["id"] for r in sampling.sample(df, 20, "id").collect()]
    b = [r["id"] for r in sampling.sample(df, 20, "id").collect()]
    assert a == b and len(set(a)) == 20


def test_split_refuses_keys_that_repeat_at_a_boundary(spark):
    import pytest
    with pytest.raises(ValueError, match="unique key"):
        sampling.split(spark.range(100).selectExpr("id % 2 AS k"), "k")

import importlib

from tests.conftest import SMALL  # noqa: F401


def test_entry_runs_and_registry_consistent(spark):
    entry = importlib.import_module("__spark_entry__")
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 13 and set(df.columns) == {"metric", "value"}
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 70


def test_small_queries_run_on_smallest_tables(spark):
    entry = importlib.import_module("__spark_entry__")
    q = entry.queries()
    for name in ("knn_top5", "clean_text", "assemble_text", "label_dict", "precision_coverage",
                 "split_sizes", "hier_check", "vector_check"):
        q[name](spark, "/root/testdata/sf0.001").collect()

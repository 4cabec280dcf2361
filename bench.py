"""Benchmark of the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 3). Every query is executed completely through the
``noop`` sink (no collection to the driver); the reported time is the median
of the runs. Training of the supervised model (vocabulary + early-stopped fit)
is timed once on its own; ``test_accuracy`` then uses the trained model.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from textcoder.operators import cell_index  # noqa: E402
from textcoder.plans import catalog  # noqa: E402
from textcoder.session import build_session, work_dir  # noqa: E402

HEADLINE = [
    ("clean_text", "P1 documents cleaned"),
    ("assemble_text", "P2-P8 nomenclature validated and assembled"),
    ("hash_embed", "G1 documents embedded (Arrow batches)"),
    ("hash_embed_native", "G1 native twin (explode + aggregate)"),
    ("knn_top5", "J2 exact kNN, broadcast plan"),
    ("knn_blocks", "J2 exact kNN, tiled shuffle plan"),
    ("knn_cells", "J3 cell-probed kNN, index built for one search"),
    ("rag_metrics", "A9 metric table"),
    ("classify_batch", "G11 batch classification to export rows"),
    ("batch_coding", "G7 prompt, response, parse, evaluation"),
    ("bm25_rrf", "D7 BM25 + dense, rank fusion"),
    ("split_sizes", "M1 exact-size split"),
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(master=f"local[{cpus}]", app_name="textcoder-bench",
                          shuffle_partitions=2 * cpus)
    run(catalog.REGISTRY["head_n"](spark, root))          # start-up, not timed
    times: dict[str, float] = {}
    for name, _ in HEADLINE:
        fn = catalog.REGISTRY[name]
        samples = []
        for _ in range(runs):
            t0 = time.perf_counter()
            run(fn(spark, root))
            samples.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(samples), 3)
    # A stored cell index: built once, probed many times.
    e = catalog.vectors(spark, root)
    t0 = time.perf_counter()
    index = cell_index.build_index(e, work_dir(spark, "bench-cells"), corpus_id="vec_id", corpus_vec="embedding")
    times["index_build"] = round(time.perf_counter() - t0, 3)
    samples = []
    for _ in range(runs):
        t0 = time.perf_counter()
        run(cell_index.search(index, e, 5, query_id="vec_id", query_vec="embedding", exclude_self=True))
        samples.append(time.perf_counter() - t0)
    times["index_probe"] = round(statistics.median(samples), 3)
    t0 = time.perf_counter()
    catalog.trained(spark, root)
    times["train_supervised"] = round(time.perf_counter() - t0, 3)
    samples = []
    for _ in range(runs):
        t0 = time.perf_counter()
        run(catalog.REGISTRY["test_accuracy"](spark, root))
        samples.append(time.perf_counter() - t0)
    times["test_accuracy"] = round(statistics.median(samples), 3)
    sf = os.path.basename(root.rstrip("/")).replace("sf", "")
    n_docs = spark.read.parquet(f"{root}/documents.parquet").count()
    n_parts = spark.read.parquet(f"{root}/part.parquet").count()
    n_vec = spark.read.parquet(f"{root}/embeddings.parquet").count()
    pairs = n_vec * (n_vec - 1)                      # leave-one-out query x corpus pairs

    def rate(n, name):
        return round(n / times[name], 1) if times.get(name) else None

    throughput = {
        "documents_cleaned_per_sec": rate(n_docs, "clean_text"),
        "documents_embedded_per_sec": rate(n_docs, "hash_embed"),
        "knn_pairs_per_sec_broadcast": rate(pairs, "knn_top5"),
        "knn_pairs_per_sec_tiled": rate(pairs, "knn_blocks"),
        "rows_classified_per_sec": rate(n_parts, "classify_batch"),
    }
    recall = catalog.REGISTRY["cells_recall"](spark, root).first()
    acc = catalog.REGISTRY["test_accuracy"](spark, root).first()
    quality = {"cells_recall_at_5": recall["recall"],
               "cells_speedup_vs_exact": round(times["knn_top5"] / times["index_probe"], 3), "cells_probed": f"{index.nprobe} of {index.n_cells}",
               "supervised_test_accuracy": acc["accuracy"]}
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus, "runs": runs,
                      "throughput": throughput, "quality": quality}))
    spark.stop()


if __name__ == "__main__":
    main()

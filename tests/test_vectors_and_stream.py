from pyspark.sql import functions as F

from textcoder.operators.embed import HashingEmbedder, embed, hashed_counts
from textcoder.session import work_dir
from textcoder.sources import vector_table as vt


def _points(spark, rows):
    return spark.createDataFrame(
        rows, "id string, vector array<float>, "
              "payload struct<code:string,level:int,parent_code:string,text:string>")


def test_upsert_idempotent_and_checks_dim(spark):
    path = work_dir(spark, "vt-test")
    vt.create_or_replace(spark, path, 2, "cosine")
    assert vt.table_exists(spark, path) and vt.table_count(spark, path) == 0
    assert not vt.table_exists(spark, path + "-missing")
    p = ("a", 1, None, "t")
    rows = [("x", [1.0, 0.0], p), ("x", [0.0, 1.0], p), ("y", [1.0, 1.0], p),
            ("z", [1.0, 0.0, 0.0], p), ("w", None, p)]
    r1 = vt.upsert(spark, path, _points(spark, rows)).first()
    assert r1["n_rejected"] == 2 and r1["n_rows"] == 2
    r2 = vt.upsert(spark, path, _points(spark, rows)).first()
    assert r2["n_rows"] == 2 and r2["version"] == 2
    got = {r["id"]: list(r["vector"]) for r in vt.read_points(spark, path).collect()}
    assert got["x"] == [0.0, 1.0]                  # last row of the batch wins
    vt.upsert(spark, path, _points(spark, [("x", [5.0, 5.0], p)]))
    got = {r["id"]: list(r["vector"]) for r in vt.read_points(spark, path).collect()}
    assert got["x"] == [5.0, 5.0] and got["y"] == [1.0, 1.0]


def test_a_small_upsert_writes_little_and_old_versions_stay(spark, tmp_path):
    path, p = str(tmp_path / "vt"), ("a", 1, None, "t")
    vt.create_or_replace(spark, path, 2, "cosine")
    vt.upsert(spark, path, _points(spark, [(str(i), [float(i), 1.0], p) for i in range(1000)]))
    reports = [vt.upsert(spark, path, _points(spark, [(str(i), [0.0, float(n)], p), (f"new{n}", [1.0, 1.0], p)])).first()
               for n, i in enumerate(range(0, 50, 10))]
    assert [r["n_rows"] for r in reports] == [1001, 1002, 1003, 1004, 1005]
    log = {r["version"]: r for r in vt.commits(spark, path).collect()}
    bases = [v for v, r in log.items() if r["kind"] == "base"]
    assert all(log[r["version"]]["rows"] == 2 for r in reports) and len(bases) == 1
    got = {r["id"]: list(r["vector"]) for r in vt.read_points(spark, path).collect()}
    assert got["40"] == [0.0, 4.0] and got["39"] == [39.0, 1.0] and got["new0"] == [1.0, 1.0]
    before = {r["id"]: list(r["vector"]) for r in vt.read_points(spark, path, reports[0]["version"]).collect()}
    assert before["40"] == [40.0, 1.0] and "new1" not in before and len(before) == 1001
    vt.compact(spark, path)
    assert {r["id"]: list(r["vector"]) for r in vt.read_points(spark, path).collect()} == got
    vt.create_or_replace(spark, path, 3, "l2")
    assert vt.table_count(spark, path) == 0 and vt.table_meta(spark, path) == (3, "l2")
    assert len(vt.read_points(spark, path, reports[-1]["version"]).collect()) == 1005


def test_two_writers_do_not_make_one_version(spark, tmp_path, monkeypatch):
    path, p = str(tmp_path / "vt"), ("a", 1, None, "t")
    vt.create_or_replace(spark, path, 2, "cosine")
    monkeypatch.setattr(vt, "newest", lambda *_: 0)             # both writers have seen version 0
    first = vt.upsert(spark, path, _points(spark, [("x", [1.0, 0.0], p)])).first()["version"]
    second = vt.upsert(spark, path, _points(spark, [("y", [1.0, 0.0], p)])).first()["version"]
    assert (first, second) == (1, 2)
    assert vt.compact(spark, path) is None                      # it would be version 1, which is taken
    monkeypatch.undo()
    assert {r["id"] for r in vt.read_points(spark, path).collect()} == {"x", "y"}
    # A writer that is lost after its claim leaves a gap that nobody reads.
    after = vt.newest(spark, path) + 1
    assert vt._claim(spark, path, after) and not vt._claim(spark, path, after)
    assert vt.upsert(spark, path, _points(spark, [("z", [1.0, 0.0], p)])).first()["version"] == after + 1
    assert vt.table_count(spark, path) == 3
    assert sorted(r.why for r in vt.read_rejects(spark, path, vt.upsert(spark, path, _points(
        spark, [(None, [1.0, 0.0], p), ("q", None, p), ("r", [1.0], p)])).first()["version"]).collect()) == ["null id", "null vector", "wrong dimension"]


def test_batch_embedder_equals_native(spark):
    df = spark.createDataFrame([(1, "Le chat, le chien."), (2, "Über 3 Äpfel"), (3, "")],
                               "id long, text string")
    dense = {r["id"]: r["vector"] for r in embed(df, "text", dim=64).collect()}
    native = hashed_counts(df, "id", "text", 64).collect()
    for r in native:
        assert abs(dense[r["id"]][r["bucket"]] - r["weight"]) < 1e-12
    assert sum(dense[3]) == 0.0
    assert HashingEmbedder(64)(["le chat"]).shape == (1, 64)


def test_stream_equals_batch(spark):
    from textcoder.streaming.classify_stream import read_stream_output, run_classification_stream
    base = work_dir(spark, "stream-test")
    rows = spark.range(0, 40).select(F.col("id").cast("string").alias("id"),
                                     F.concat(F.lit("item "), F.col("id")).alias("activity_description"))
    rows.repartition(4).write.parquet(f"{base}/in")

    def classify(b):
        return b.withColumn("n", F.length("activity_description"))

    prog = run_classification_stream(spark, f"{base}/in", f"{base}/out", f"{base}/chk", classify)
    out = read_stream_output(spark, f"{base}/out")
    assert sorted(r["id"] for r in out.collect()) == sorted(r["id"] for r in rows.collect())
    assert sum(p["input_rows"] for p in prog) == 40 and len(prog) == 4


def test_stream_reports_input_rows_empty_batches_and_failures(spark, tmp_path):
    from textcoder.streaming.classify_stream import job_progress, read_stream_output, run_classification_stream
    base = str(tmp_path)
    rows = spark.range(0, 30).selectExpr("cast(id AS string) AS id", "concat('item ', id) AS activity_description")
    rows.repartition(3).write.parquet(f"{base}/in")
    state = {"broken": True, "batches": 0}

    def classify(b):
        state["batches"] += 1
        if state["broken"] and state["batches"] == 2:
            raise ValueError("model gone")
        return b.where("cast(id AS int) < 0")                   # writes nothing

    run = dict(files_per_trigger=1, fail=False)
    first = run_classification_stream(spark, f"{base}/in", f"{base}/out", f"{base}/chk", classify, **run)
    assert [(p["batch_id"], p["state"], p["output_rows"]) for p in first] == [(0, "done", 0), (1, "failed", None)]
    assert first[1]["error"].startswith("ValueError: model gone") and first[0]["input_rows"] == 10
    state["broken"] = False
    again = run_classification_stream(spark, f"{base}/in", f"{base}/out", f"{base}/chk", classify, **run)
    assert [(p["batch_id"], p["state"]) for p in again] == [(1, "done"), (2, "done")]            # this run's batches only
    log = job_progress(spark, f"{base}/out").orderBy("batch_id").collect()
    assert [(r.batch_id, r.input_rows, r.output_rows, r.state) for r in log] == [(0, 10, 0, "done"), (1, 10, 0, "done"), (2, 10, 0, "done")]
    assert read_stream_output(spark, f"{base}/out").count() == 0
    assert job_progress(spark, f"{base}/none").count() == 0


def test_upload_status_per_batch(spark):
    path = work_dir(spark, "vt-status")
    vt.create_or_replace(spark, path, 2, "cosine")
    p = ("a", 1, None, "t")
    pts = _points(spark, [("x", [1.0, 0.0], p), ("y", [1.0], p)]).repartition(1)
    vt.upsert(spark, path, pts)
    st = vt.upload_status(spark, path, 1).collect()
    assert sum(r["rows"] for r in st) == 2 and sum(r["rejected"] for r in st) == 1
    assert {r["error"] for r in st} == {"wrong dimension"}


def test_upsert_embeds_each_row_once_and_planning_runs_no_job(spark, tmp_path):
    from pyspark.sql import functions as F

    from textcoder.operators.partitioning import spread
    from textcoder.sources import vector_table as vt

    made = spark.sparkContext.accumulator(0)

    def embed(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    df = spark.range(100).select(F.col("id").cast("string").alias("id"), F.array(F.lit(0.5), F.lit(1.0)).alias("vector"),
                                 F.lit(None).cast("struct<code:string,level:int,parent_code:string,text:string>").alias("payload"))
    path = str(tmp_path / "vt")
    vt.create_or_replace(spark, path, 2)
    vt.upsert(spark, path, df.mapInArrow(embed, df.schema))
    assert made.value == 100 and vt.table_count(spark, path) == 100
    spread(df.mapInArrow(embed, df.schema).groupBy("id").count())
    assert made.value == 100


def test_a_task_holds_a_bounded_number_of_vectors(spark, tmp_path, monkeypatch):
    """Files and the partitions in which latest rows are found are bounded by the vectors in memory; a hot id and repeated upserts keep the last row."""
    monkeypatch.setattr(vt, "POINT_BYTES", 50 * (4 * 2 + 256))
    monkeypatch.setattr(vt, "BROADCAST_IDS", 100)
    path, p = str(tmp_path / "vt"), ("a", 1, None, "t")
    vt.create_or_replace(spark, path, 2, "cosine")
    rows = [(f"{i}" if i % 2 else "hot", [float(i), 1.0], p) for i in range(1000)]
    points = _points(spark, rows).coalesce(1)
    assert [tuple(vt.upsert(spark, path, points).first()) for _ in range(2)] == [(1, 0, 501), (2, 0, 501)]
    folders = [r["folder"] for r in vt.commits(spark, path).collect() if r["kind"] != "empty"]
    assert len(folders) == 3                                                        # two deltas and the base they were joined into
    for folder in folders:
        for what in ("staged", "points"):
            if (tmp_path / "vt" / "data" / folder / what).exists():
                held = spark.read.parquet(f"{path}/data/{folder}/{what}").groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
                assert held <= (50 if what == "staged" else 100)                    # points are dealt by hash
    dealt = vt._latest(spark.read.parquet(f"{path}/data/{folders[0]}/staged"), "seq", 1000, 2)
    assert max(dealt.rdd.glom().map(len).collect()) <= 100
    vt.upsert(spark, path, _points(spark, [(str(i), [0.0, 2.0], p) for i in range(1, 401)]))                # more ids than are broadcast
    got = {r["id"]: list(r["vector"]) for r in vt.read_points(spark, path).collect()}
    assert len(got) == 501 + 200 and got["hot"] == [998.0, 1.0] and got["399"] == [0.0, 2.0] and got["401"] == [401.0, 1.0]

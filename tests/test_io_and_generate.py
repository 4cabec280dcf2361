import os
import tempfile

import pytest

from pyspark.sql import functions as F

from textcoder.operators.generation import build_prompts, generate, parse_response
from textcoder.session import work_dir
from textcoder.sources.activity_csv import format_3f, write_classification_csv
from textcoder.sources.nomenclature import read_labels, read_nomenclature


def test_read_nomenclature_tsv_all_strings(spark):
    d = tempfile.mkdtemp(prefix="tsv-")
    p = os.path.join(d, "nace.tsv")
    with open(p, "w", encoding="utf-8") as f:
        f.write("CODE\tHEADING\tLEVEL\tPARENT_CODE\tIncludes\tIncludesAlso\tExcludes\n")
        f.write("A\tAgriculture\t1\t\t\t\t\n")
        f.write('01\tCrops\t2\tA\t"line one\nline two"\t\tnot fish\n')
        f.write("01\tCrops again\t2\tA\t\t\t\n")
    raw = read_nomenclature(spark, p)
    assert all(f.dataType.simpleString() == "string" for f in raw.schema.fields if f.name != "row_no")
    rows = raw.orderBy("row_no").collect()
    assert [r["CODE"] for r in rows] == ["A", "01", "01"]
    assert rows[1]["Includes"] == "line one\nline two"
    assert read_labels(spark, p).columns == ["CODE", "HEADING", "row_no"]


def test_format_3f_is_python_rounding(spark):
    vals = [0.0625, 0.0005, 0.1235, 1.0, 0.0, 0.9995]
    df = spark.createDataFrame([(v,) for v in vals], "c double")
    got = [r["f"] for r in df.select(format_3f("c").alias("f")).collect()]
    assert got == [f"{v:.3f}" for v in vals]


def test_pluggable_generator_batches_and_errors(spark):
    df = spark.createDataFrame([("bake", ["10.71"], ["# Code: 10.71"]),
                                ("fish", ["03.11"], ["# Code: 03.11"])],
                               "a string, codes array<string>, texts array<string>")
    p = build_prompts(df, "a")

    def model(systems, users):
        return ['{"nace_code": "%s", "codable": true, "confidence": 0.7}' % u.split("codes: ")[-1]
                for u in users]

    out = generate(p, model).withColumn("parsed", parse_response("response"))
    got = {r["a"]: r["parsed"]["nace_code"] for r in out.collect()}
    assert got == {"bake": "10.71", "fish": "03.11"}

    def broken(systems, users):
        raise TimeoutError("service down")

    bad = generate(p, broken).collect()
    assert all(r["response"] is None and "service down" in r["gen_error"] for r in bad)


def test_export_csv_round_trip(spark):
    rows = spark.createDataFrame(
        [("1", 'say "hi", then\nleave', "", "Not codable", "0.000")],
        "id string, activity_description string, code string, label string, confidence string")
    path = write_classification_csv(rows, work_dir(spark, "export-test"))
    back = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
            .csv(path).collect())
    assert back[0]["activity_description"] == 'say "hi", then\nleave'
    assert back[0]["code"] is None or back[0]["code"] == ""
    text = "".join(open(os.path.join(path.replace("file:", ""), f)).read()
                   for f in os.listdir(path.replace("file:", "")) if f.endswith(".csv"))
    assert '"say ""hi"", then' in text


def test_failing_rows_of_an_embedder_lose_only_themselves(spark):
    from textcoder.operators.calls import Retry
    from textcoder.operators.embed import embed

    def fussy(texts):
        if any("bad" in t for t in texts):
            raise ValueError("no bad words")
        return [[float(len(t)), 1.0] for t in texts]

    rows = spark.createDataFrame([(i, "bad" if i in (7, 30) else "x" * i) for i in range(50)], "id long, text string").coalesce(1)
    got = {r.id: (r.vector, r.why) for r in embed(rows, "text", fussy, error_col="why", concurrent=2).collect()}
    assert {i for i, (v, _) in got.items() if v is None} == {7, 30} and got[7][1] == "ValueError: no bad words"
    assert all(v == [float(i), 1.0] and w is None for i, (v, w) in got.items() if i not in (7, 30))
    assert embed(rows, "text", fussy, error_col="why", concurrent=2).rdd.getNumPartitions() == 2
    with pytest.raises(Exception, match="embedding failed for rows"):
        embed(rows, "text", fussy, id_col="id", retry=Retry(2, 0.0)).collect()


def test_answers_retry_with_growing_pauses_and_halve():
    from textcoder.operators.calls import Retry, answers
    pauses, calls = [], []

    def third_time(rows):
        calls.append(len(rows))
        if len(calls) < 3:
            raise OSError("busy")
        return [r * 2 for r in rows]

    assert answers(third_time, [1, 2], Retry(4, 1.0, 1.5), pauses.append) == ([2, 4], [None, None])
    assert pauses == [1.0, 1.5] and calls == [2, 2, 2]
    sizes = []

    def no_seven(rows):
        sizes.append(len(rows))
        if 7 in rows:
            raise OSError("seven")
        return rows
    found, errors = answers(no_seven, list(range(64)))
    assert found == [None if i == 7 else i for i in range(64)] and errors[7] == "OSError: seven" and len(sizes) == 13
    assert answers(lambda rows: rows[1:], [1]) == ([None], ["RuntimeError: 0 answers for 1 rows"])


def test_a_killed_batch_job_resumes_at_its_batch(spark, tmp_path):
    from textcoder.operators.calls import Retry, run_in_batches
    rows = spark.range(100).withColumnRenamed("id", "id")
    ran, broken = [], {"on": True}

    def job(part):
        ran.append(part.count())
        if broken["on"] and len(ran) == 3:
            raise KeyboardInterrupt                     # the run is killed in its third batch
        return part.selectExpr("id", "id * 2 AS twice")

    out = str(tmp_path / "out")
    with pytest.raises(KeyboardInterrupt):
        run_in_batches(spark, rows, out, job, batches=5)
    assert spark.read.parquet(out).count() == sum(ran[:2])
    broken["on"], ran[:] = False, []
    report = run_in_batches(spark, rows, out, job, batches=5).collect()
    assert [r.state for r in report] == ["done before"] * 2 + ["done"] * 3 and len(ran) == 3
    assert sorted((r.id, r.twice) for r in spark.read.parquet(out).collect()) == [(i, 2 * i) for i in range(100)]

    def fails(part):
        if part.where("id = 5").count():
            raise ValueError("five")
        return part
    other = str(tmp_path / "other")
    report = run_in_batches(spark, rows, other, fails, batches=5, retry=Retry(2, 0.0)).collect()
    assert sorted(r.state for r in report) == ["done"] * 4 + ["failed"]
    assert [(r.attempts, r.error) for r in report if r.state == "failed"] == [(2, "ValueError: five")]
    assert spark.read.parquet(other).count() < 100

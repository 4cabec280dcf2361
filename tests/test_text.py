import uuid

from pyspark.sql import functions as F

from textcoder.functions import text as tx
from textcoder.operators.validate import label_dict, to_documents, validate_nomenclature
from textcoder.sources.nomenclature import RAW_COLUMNS


def _one(spark, col_expr, value):
    return spark.createDataFrame([(value,)], "v string").select(col_expr.alias("r")).first()["r"]


def test_clean_text_matches_python_split(spark):
    cases = ["  a \t b\n\nc  ", "", "   ", None, "x y", "a b c d", "é  ü", "a\x1cb",
             "tab\tend\t", "a b"]
    df = spark.createDataFrame([(c,) for c in cases], "v string")
    got = [r["r"] for r in df.select(tx.clean_text("v").alias("r")).collect()]
    assert got[:4] == ["a b c", None, None, None]
    assert got[5:] == ["a b c d", "é ü", "a b", "tab end", "a b"]


def test_strip_matches_python(spark):
    for v in ["  x y  ", " \tcode \n", "z", " a b ", "  "]:
        assert _one(spark, tx.strip("v"), v) == v.strip()


def test_uuid5_equals_python(spark):
    names = ["01.11", "A", "é-code", "中文", "x" * 200]
    df = spark.createDataFrame([(n,) for n in names], "code string")
    got = [r["id"] for r in df.select(tx.uuid5("code").alias("id")).collect()]
    ns = uuid.uuid5(uuid.NAMESPACE_DNS, "nace-rev2")
    assert got == [str(uuid.uuid5(ns, n)) for n in names]


def test_assemble_text_blocks(spark):
    df = spark.createDataFrame(
        [("01.1", "Growing", "wheat\\nrice", None, "fish"), ("02", "Forestry", None, None, None)],
        "code string, heading string, includes string, includes_also string, excludes string")
    out = [r["t"] for r in df.select(tx.assemble_text(
        "code", "heading", "includes", "includes_also", "excludes").alias("t")).collect()]
    assert out[0] == ("# Code: 01.1\n# Title: Growing\n\n## Includes:\nwheat\nrice"
                      "\n\n## Excludes:\nfish")
    assert out[1] == "# Code: 02\n# Title: Forestry"
    out2 = df.select(tx.assemble_text("code", "heading", "includes", "includes_also", "excludes",
                                      with_excludes=False).alias("t")).first()["t"]
    assert "Excludes" not in out2


def _raw(spark, rows):
    cols = ", ".join(f"{c} string" for c in RAW_COLUMNS) + ", row_no bigint"
    return spark.createDataFrame(rows, cols)


def test_validation_rules(spark):
    rows = [
        ("A", "Agriculture", "1", None, None, None, None, 1),
        ("01", "Crops", " 2 ", "A", None, None, None, 2),
        ("", "x", "1", None, None, None, None, 3),
        ("B", None, "1", None, None, None, None, 4),
        ("C", "ok", "4.0", "A", None, None, None, 5),
        ("D", "ok", "0", None, None, None, None, 6),
        ("E", "ok", "5", "A", None, None, None, 7),
        ("F", "ok", "x", None, None, None, None, 8),
        ("G", "ok", "3", "  ", None, None, None, 9),
        ("H", "   ", "1", None, None, None, None, 10),
    ]
    v = validate_nomenclature(_raw(spark, rows))
    err = {r["CODE"]: r["error"] for r in v.collect()}
    assert err["A"] is None and err["01"] is None
    assert err[""] == "absent: CODE"
    assert err["B"] == "absent: HEADING"
    assert err["C"].startswith("level not in 1..4")
    assert err["D"] == "level not in 1..4: 0" and err["E"] == "level not in 1..4: 5"
    assert err["F"].startswith("level not in 1..4")
    assert err["G"] == "no parent at level 3: G"
    assert err["H"] == "heading without text: H"
    docs = to_documents(v).collect()
    assert {d["code"] for d in docs} == {"A", "01"}
    assert {d["code"]: d["level"] for d in docs}["01"] == 2


def test_label_dict_last_wins(spark):
    rows = [(" 01 ", "first", "1", None, None, None, None, 1),
            ("01", " second ", "1", None, None, None, None, 2),
            ("02", "", "1", None, None, None, None, 3)]
    d = {r["code"]: r["label"] for r in label_dict(_raw(spark, rows)).collect()}
    assert d == {"01": "second"}


def test_char_count_and_stem(spark):
    assert _one(spark, tx.char_count("v", ";"), "a;b;c") == 2
    assert _one(spark, tx.basename_stem("v"), "/x/y/report.final.csv") == "report.final"

import os
import tempfile

import pytest

from textcoder.sources.activity_csv import CsvError, read_activity_csv


def _file(content: bytes) -> str:
    d = tempfile.mkdtemp(prefix="csvtest-")
    p = os.path.join(d, "upload.csv")
    with open(p, "wb") as f:
        f.write(content)
    return p


def _rows(spark, content: bytes, **kw):
    return [(r["id"], r["activity_description"])
            for r in read_activity_csv(spark, _file(content), **kw).collect()]


def test_header_shape_bom_and_case(spark):
    data = "﻿id,Activity_Description\n7, bake bread \n8,\n\n9,\"fish, chips\"\n".encode()
    got = sorted(_rows(spark, data), key=lambda r: int(r[0]))
    assert got == [("1", "bake bread"), ("2", "fish, chips")]


def test_keep_id_option(spark):
    data = b"id,activity_description\n7,bake\n9,fry\n"
    assert sorted(_rows(spark, data, keep_id=True)) == [("7", "bake"), ("9", "fry")]


def test_two_columns_no_header_first_row_is_data(spark):
    data = "x;grow wheat\ny;raise sheep\n".encode()
    got = sorted(_rows(spark, data), key=lambda r: int(r[0]))
    assert got == [("1", "grow wheat"), ("2", "raise sheep")]


def test_single_column_and_quoted_newline(spark):
    data = b'"multi\nline"\nplain\n'
    got = sorted(_rows(spark, data), key=lambda r: int(r[0]))
    assert got == [("1", "multi\nline"), ("2", "plain")]


def test_duplicate_header_last_wins(spark):
    data = b"activity_description,activity_description\nfirst,second\n"
    assert _rows(spark, data) == [("1", "second")]


def test_errors(spark):
    with pytest.raises(CsvError):
        read_activity_csv(spark, _file(b""))
    with pytest.raises(CsvError):
        read_activity_csv(spark, _file(b"activity_description\n"))
    with pytest.raises(CsvError):
        read_activity_csv(spark, _file(b"\xff\xfe\xfa bad bytes\n"))


def test_folder_of_files_in_name_order_with_repeated_headers(spark):
    d = tempfile.mkdtemp(prefix="csvdir-")
    for name, body in (("part-00001.csv", "activity_description\nthird\nfourth\n"),
                       ("part-00000.csv", "activity_description\nfirst\nsecond\n")):
        with open(os.path.join(d, name), "w", encoding="utf-8") as f:
            f.write(body)
    got = sorted(((int(i), t) for i, t in
                  (tuple(r) for r in read_activity_csv(spark, d).collect())))
    assert got == [(1, "first"), (2, "second"), (3, "third"), (4, "fourth")]


def test_split_single_row_table(spark):
    from textcoder.operators.sampling import split
    s = split(spark.range(0, 1).withColumnRenamed("id", "k"), "k").collect()
    assert [r["split"] for r in s] == ["test"]


def test_header_like_rows_and_empty_cells_at_the_end(spark, tmp_path):
    again = tmp_path / "again.csv"
    again.write_text("activity_description\nbake\nActivity_Description\nfry\n")
    got = [r["activity_description"] for r in read_activity_csv(spark, str(again)).collect()]
    assert sorted(got) == ["Activity_Description", "bake", "fry"]
    wide = tmp_path / "wide.csv"
    wide.write_text("bakery,\nx,bread\n")
    assert [r["activity_description"] for r in read_activity_csv(spark, str(wide)).collect()] == ["bread"]


def _python_rows(text: str, delim: str) -> list[list[str]]:
    import csv
    import io
    return [r for r in csv.reader(io.StringIO(text), delimiter=delim)]


def test_records_are_those_of_a_sequential_parser(spark, tmp_path):
    """Random quotes, delimiters and line breaks, cut into splits of a few bytes."""
    import random

    from pyspark.sql import functions as F

    from textcoder.sources.csv_records import cells, records
    rng = random.Random(6)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for n in range(6):
            text = "".join(rng.choices(['a', 'b', '"', '""', ',', ';', '\n', '\n', 'word'], k=400)) + "\n"
            path = tmp_path / f"f {n}.csv"
            path.write_text(text)
            assert spark.read.text(str(path)).rdd.getNumPartitions() > 3
            got = records(spark, str(path), ",").select(*("file", "block", "at"), cells(F.col("value"), ",").alias("c")).collect()
            got = [r["c"] for r in sorted(got, key=lambda r: r[:3])]
            # A parser that has read the last line without a closing quote keeps the line break.
            assert [[c.rstrip("\n") for c in r] for r in got] == [[c.rstrip("\n") for c in r] for r in _python_rows(text, ",")], text
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_what_a_line_does_to_the_state():
    from textcoder.sources.csv_records import KEEP, SWAP, TO_INSIDE, TO_OUTSIDE, line_effect
    cases = {'plain': KEEP, 'a,"b': SWAP, '"a","b"': TO_OUTSIDE, '"a': SWAP, 'a"b': TO_OUTSIDE, '"",""': KEEP, '""': KEEP, '"x""': SWAP, '"x"","': KEEP,
             'it"s,5", "x"': TO_OUTSIDE, 'x",y,"z': TO_INSIDE, '': KEEP}
    assert {k: line_effect(k, ",") for k in cases} == cases


def test_no_cap_on_blank_lines_record_lines_or_cells(spark, tmp_path):
    late = b"\n" * 205 + b" , ,\n" + b"id,Activity_Description\n1,bake\n2,fry\n"
    assert sorted(_rows(spark, late)) == [("1", "bake"), ("2", "fry")]
    tall = b'"' + b"x\n" * 310 + b'",activity_description\n1,bake\n'
    assert _rows(spark, tall) == [("1", "bake")]
    wide = b"activity_description,x\nbake," + b"," * 3000 + b"\nfry,1\n"
    assert sorted(_rows(spark, wide)) == [("1", "bake"), ("2", "fry")]
    folder = tmp_path / "a blank in it"
    folder.mkdir()
    (folder / "up load.csv").write_bytes(b"activity_description\nbake\n")
    assert [r["activity_description"] for r in read_activity_csv(spark, str(folder / "up load.csv")).collect()] == ["bake"]
    assert _rows(spark, b"activity_description,q\nbake,\"open\nfry,1\n") == [("1", "bake")]


def test_python_steps_take_slices_of_bounded_batches(spark, monkeypatch):
    import pyarrow as pa

    from textcoder.operators import partitioning
    from textcoder.sources import csv_records
    taken = []
    real = partitioning.slices

    def watched(*a, **kw):
        for part in real(*a, **kw):
            taken.append(part.num_rows)
            yield part

    monkeypatch.setattr(csv_records, "slices", watched)
    texts = ["x" * 200_000, None, "", '"a'] * 10 + ["b"] * 9000
    got = csv_records._sliced(pa.array(texts), lambda x: None if x is None else len(x), pa.int32())
    assert got.to_pylist() == [None if x is None else len(x) for x in texts] and got.type == pa.int32()
    assert len(taken) >= 7 and max(taken) <= csv_records.SLICE_RECORDS
    assert csv_records._sliced(pa.array([], pa.string()), len, pa.int32()).to_pylist() == []
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    with partitioning.bounded_batches(spark):
        assert int(spark.conf.get(name)) <= 8 << 20
    assert spark.conf.get(name) == before

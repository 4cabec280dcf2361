import uuid

from hypothesis import given, settings
from hypothesis import strategies as st

from textcoder.functions import text as tx

WS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\xa0 　 "
texts = st.text(alphabet=st.sampled_from(list("ab é中") + list(WS)), max_size=30)


@settings(max_examples=30, deadline=None)
@given(st.lists(texts, min_size=1, max_size=20))
def test_clean_and_strip_match_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = df.select(tx.clean_text("v").alias("c"), tx.strip("v").alias("s")).collect()
    for v, r in zip(values, got):
        solid = [c for c in v if not c.isspace()]
        assert (r["c"] is None) == (not solid)
        assert [c for c in r["c"] or "" if c != " "] == solid
        assert "  " not in (r["c"] or "") and not (r["c"] or "x")[0].isspace() and not (r["c"] or "x")[-1].isspace()
        assert r["s"] == v.strip()


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(min_size=1, max_size=20), min_size=1, max_size=20))
def test_uuid5_matches_python_for_any_text(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "code string")
    got = [r["id"] for r in df.select(tx.uuid5("code").alias("id")).collect()]
    ns = uuid.uuid5(uuid.NAMESPACE_DNS, tx.ID_NAMESPACE_NAME)
    assert got == [str(uuid.uuid5(ns, n)) for n in names]

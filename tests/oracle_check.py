"""Run registered queries and their DuckDB statements side by side (like the driver).

usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

import __spark_entry__ as entry  # noqa: E402
from textcoder.session import build_session  # noqa: E402
from textcoder.sources.tables import TABLES  # noqa: E402


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


_TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
          "boolean": "BOOLEAN", "float": "FLOAT", "timestamp": "TIMESTAMP WITH TIME ZONE",
          "timestamp_ntz": "TIMESTAMP", "date": "DATE", "smallint": "SMALLINT"}


def _duck_type(t: str) -> str:
    if t.startswith("array<") and t.endswith(">"):
        return _duck_type(t[6:-1]) + "[]"
    return _TYPES.get(t, t)


def compare(spark, con, name, fn, sql, root):
    t = time.time()
    sdf = fn(spark, root)
    cols = sdf.columns
    srows = [tuple(_norm(r[c]) for c in sorted(cols)) for r in sdf.collect()]
    st = time.time() - t
    if sql is None:
        return f"{name:28s} rows-only spark={len(srows):6d}  ({st:.1f}s)", True
    rel = con.sql(sql)
    dcols = rel.columns
    drows = [tuple(_norm(r[dcols.index(c)]) for c in sorted(dcols)) for r in rel.fetchall()]
    ok_cols = sorted(cols) == sorted(dcols)
    stypes = {f.name: _duck_type(f.dataType.simpleString()) for f in sdf.schema.fields}
    dtypes = dict(zip(dcols, [str(t) for t in rel.types]))
    type_diff = {c: (stypes[c], dtypes.get(c)) for c in cols if stypes[c] != dtypes.get(c)}
    same = ok_cols and sorted(map(repr, srows)) == sorted(map(repr, drows))
    msg = f"{name:28s} {'OK  ' if same else 'FAIL'} spark={len(srows):6d} duck={len(drows):6d} ({st:.1f}s)"
    if type_diff:
        msg += f"\n   TYPES {type_diff}"
    if not ok_cols:
        msg += f"\n   cols spark={sorted(cols)} duck={sorted(dcols)}"
    elif not same:
        a, b = set(map(repr, srows)), set(map(repr, drows))
        msg += f"\n   spark-only {sorted(a - b)[:3]}\n   duck-only  {sorted(b - a)[:3]}"
    return msg, same


def main():
    root = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = build_session(shuffle_partitions=8)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{root}/{t}.parquet')")
    qs, ors = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        try:
            msg, ok = compare(spark, con, name, fn, ors.get(name), root)
        except Exception as exc:  # report and go on
            msg, ok = f"{name:28s} ERROR {type(exc).__name__}: {str(exc)[:400]}", False
        bad += not ok
        print(msg, flush=True)
    print(f"{bad} failing")


if __name__ == "__main__":
    main()

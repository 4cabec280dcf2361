"""Plan shape of registered queries: shuffles, Python stages, scans.

usage: python -m textcoder.plans.inspect [sf_dir] query [query ...]

Prints, per query, the number of exchanges (shuffles and broadcasts), the
Python (Arrow) stages, and each Parquet scan with its pruned read schema and
pushed filters, taken from the executed physical plan.
"""

from __future__ import annotations

import re
import sys

from ..session import build_session
from .catalog import REGISTRY

_PY_NODES = ("MapInArrow", "ArrowEvalPython", "FlatMapCoGroupsInArrow",
             "FlatMapCoGroupsInPandas", "MapInPandas")


def _plan_text(df) -> str:
    """The physical plan as printed by ``DataFrame.explain()``."""
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def plan_summary(df) -> dict:
    plan = _plan_text(df)
    scans = []
    for line in plan.splitlines():
        if "FileScan parquet" in line:
            schema = re.search(r"ReadSchema: (\S+)", line)
            pushed = re.search(r"PushedFilters: \[([^\]]*)\]", line)
            scans.append({"read_schema": schema.group(1) if schema else "?",
                          "pushed_filters": pushed.group(1) if pushed else ""})
    return {"shuffles": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|"
                                       r"SinglePartition|RoundRobinPartitioning)", plan)),
            "broadcasts": plan.count("BroadcastExchange"),
            "python_stages": sum(plan.count(n) for n in _PY_NODES),
            "scans": scans}


def main(argv: list[str]) -> None:
    root = "/root/testdata/sf0.01"
    if argv and "/" in argv[0]:
        root, argv = argv[0], argv[1:]
    spark = build_session(shuffle_partitions=8)
    for name in argv:
        s = plan_summary(REGISTRY[name](spark, root))
        print(f"{name}: shuffles={s['shuffles']} broadcasts={s['broadcasts']} "
              f"python_stages={s['python_stages']}")
        for sc in s["scans"]:
            print(f"    scan {sc['read_schema']}  pushed=[{sc['pushed_filters']}]")


if __name__ == "__main__":
    main(sys.argv[1:])

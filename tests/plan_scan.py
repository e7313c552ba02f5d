"""python -m tests.plan_scan [folder]: operators in the plans of registered queries that would not hold at scale."""
from __future__ import annotations

import re
import sys

BAD = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroups")


def found_in(df):
    """Names of the operators in a plan that would not hold on large tables."""
    text = df._jdf.queryExecution().executedPlan().toString()
    found = [b for b in BAD if b in text]
    if re.search(r"windowspecdefinition\([^,]* (ASC|DESC)", text):  # no partition column before the first sort column
        found.append("window over everything")
    if re.search(r"Sort \[.*\], true", text) and "TakeOrdered" not in text:
        found.append("sort of everything")
    return found


def scan(spark, plans, folder):
    """name -> operators found, with automatic broadcasts off, so that plans are those of large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = {name: found_in(plan(spark, folder)) for name, plan in plans.items()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return {name: f for name, f in found.items() if f}


if __name__ == "__main__":
    from plumbline.plans import catalogue
    from plumbline.session import session
    s = session("scan", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__showConsoleProgress="false", spark__driver__memory="6g")
    s.sparkContext.setLogLevel("ERROR")
    for n, f in scan(s, catalogue.queries(), sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001").items():
        print(n, f)

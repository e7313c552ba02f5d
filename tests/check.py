"""python -m tests.check [folder] [name ...]: compare registered queries with their SQL."""
from __future__ import annotations

import sys
import time
import traceback

from plumbline.session import session
from tests.oracle import connect, problems


def main(argv):
    folder = argv[0] if argv else "/root/testdata/sf0.01"
    from plumbline.plans.catalogue import oracles, queries
    spark = session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g",
                    spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    every, sql, failed = queries(), oracles(), []
    for name in (argv[1:] or every):
        start = time.time()
        try:
            df = every[name](spark, folder)
            found = problems(df, con, sql[name]) if name in sql else [f"note: rows only, {df.count()} rows"]
        except Exception as e:
            found = [f"{type(e).__name__}: {str(e)[:600]}"]
            if "-v" in sys.argv:
                traceback.print_exc()
        hard = [p for p in found if not p.startswith("note")]
        if hard:
            failed.append(name)
        print(f"{'FAIL' if hard else 'ok  '} {name} {time.time() - start:.1f}s {'; '.join(found)}", flush=True)
    print(f"{len(failed)} failed: {failed}")


main(sys.argv[1:])

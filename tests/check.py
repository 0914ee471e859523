"""python tests/check.py [name part ...]: compare registered queries with their SQL at one scale."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry  # noqa: E402
from oracle import compare, duck  # noqa: E402

from cohortgrid.session import local_session  # noqa: E402

if __name__ == "__main__":
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark = local_session(8)
    con = duck(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        t = time.time()
        try:
            if name in sql:
                why = compare(fn(spark, folder), con, sql[name])
            else:
                n = len(fn(spark, folder).toPandas())
                why = None if n else "no rows"
        except Exception as exc:  # noqa: BLE001
            why = f"{type(exc).__name__}: {str(exc)[:600]}"
        took = time.time() - t
        bad += why is not None
        print(f"{'ok  ' if why is None else 'FAIL'} {took:6.2f}s {'O' if name in sql else 'R'} {name}{'' if why is None else ': ' + why}", flush=True)
    print("failures:", bad)

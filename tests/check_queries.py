"""Run every named query against its SQL: python tests/check_queries.py [dir] [names...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from flowguard.session import build_session, ensure_checkpoint_dir  # noqa: E402

if __name__ == "__main__":
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("check", master="local[8]", shuffle_partitions=8,
                          spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("OFF")
    ensure_checkpoint_dir(spark)
    con, sqls, bad = oracle.connect(sf_dir), oracle_sql(), 0
    for name, fn in queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            if name in sqls:
                diff = oracle.difference(spark, con, sf_dir, fn, sqls[name])
                status = "ok" if not diff else "DIFF " + diff
            else:
                status = f"rows {fn(spark, sf_dir).count()}"
        except Exception as exc:  # report and go on with the next query
            status = f"ERROR {type(exc).__name__} {str(exc)[:600]}"
        bad += status.startswith(("DIFF", "ERROR"))
        print(f"{name:28s} {time.time() - start:6.2f}s {status}", flush=True)
    print("failures:", bad)

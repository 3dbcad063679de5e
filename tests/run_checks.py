"""All registered queries against their SQL: python tests/run_checks.py [sf_dir] [name …]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as entry  # noqa: E402
from check import compare, connect  # noqa: E402

from muster.session import local_session  # noqa: E402

if __name__ == "__main__":
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    sql = entry.oracle_sql()
    queries = entry.queries()
    print("no query for", sorted(set(sql) - set(queries)))
    failures = 0
    for name, query in queries.items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            if name in sql:
                problem = compare(df, connection, sql[name])
                status = problem or "equal"
            else:
                status = f"{df.count()} rows, no SQL"
                problem = None
        except Exception as error:  # report and go on
            problem = status = f"{type(error).__name__}: {str(error)[:1500]}"
        failures += problem is not None
        print(f"{name:26s} {time.time() - start:6.2f}s  {status}", flush=True)
    print("failures:", failures)

"""Run registered queries against their SQL: ``python -m tests.run_queries [sf] [name-prefix ...]``."""
from __future__ import annotations

import sys
import time

from epochloom.session import local_session
from tests.harness import compare, duck


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry

    sf = f"/root/testdata/sf{argv[0] if argv else '0.01'}"
    wanted = argv[1:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start, clock = time.time(), {"spark": 0.0}
        try:
            problem = compare(spark, con, sf, fn, oracle.get(name), clock)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        kind = "sql " if name in oracle else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind} {clock['spark']:6.2f}s of {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print("failures", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]) > 0)

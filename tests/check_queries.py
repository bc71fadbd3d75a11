"""Run registered queries against their oracle: check_queries.py [sf] [names...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from epistride.session import local_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402


def main() -> None:
    folder = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    names = sys.argv[2:]
    spark, con, oracles = local_session(8), connect(folder), oracle_sql()
    failed = 0
    for name, run in queries().items():
        if names and name not in names:
            continue
        start = time.perf_counter()
        try:
            df = run(spark, folder)
            if name in oracles:
                problem = compare(df, con, oracles[name])
                note = "ok" if problem is None else f"DIFF {problem}"
            else:
                problem, note = None, f"rows {df.count()}"
        except Exception as error:  # report and go on
            problem = note = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{time.perf_counter() - start:6.2f}s {name}: {note}", flush=True)
    print(f"failed: {failed}")


if __name__ == "__main__":
    main()

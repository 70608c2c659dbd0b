"""Compare every registered query with its SQL: ``python tests/check_queries.py SF_DIR [name ...]``."""

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from oracle import compare, connect  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from tallywright import build_session  # noqa: E402


def main() -> int:
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    connection, sql, failed = connect(sf_dir), oracle_sql(), []
    for name, query in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            problem = compare(df, connection, sql[name]) if name in sql else None
            note = "" if name in sql else f" ({df.count()} rows, no SQL)"
        except Exception as error:  # noqa: BLE001
            problem, note = "".join(traceback.format_exception_only(error))[:1500], ""
            if len(names) == 1:
                traceback.print_exc()
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s{note} {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())

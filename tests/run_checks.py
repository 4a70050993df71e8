"""Run all or named queries against their SQL: run_checks.py [sf_dir] [name ...]"""

import pathlib
import sys
import time

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

import __spark_entry__ as entry  # noqa: E402
from fieldtally.session import build_session  # noqa: E402
from harness import differences, duck  # noqa: E402


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session(master="local[8]", shuffle_partitions=8, driver_memory="16g")
    spark.sparkContext.setLogLevel("OFF")
    con, failed = duck(sf), 0
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not wanted or any(n.startswith(w) for w in wanted)]
    for name in names:
        t0 = time.time()
        try:
            got = queries[name](spark, sf).toPandas()
            t1 = time.time()
            if name in oracles:
                want = con.execute(oracles[name]).df()
                note = differences(got, want)
            else:
                note = None
            t2 = time.time()
            state = "ok  " if note is None else "FAIL"
            tag = "" if name in oracles else " (rows only)"
            print(f"{state} {name:34s} rows={len(got):7d} spark={t1-t0:5.2f}s sql={t2-t1:5.2f}s{tag} {note or ''}", flush=True)
            failed += note is not None
        except Exception as exc:  # noqa: BLE001
            failed += 1
            print(f"FAIL {name:34s} {type(exc).__name__}: {str(exc)[:400]}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())

"""Compare registered queries with their SQL on one data directory.

python tests/oracle_check.py [dir] [name ...]   names may be prefixes with a trailing *
"""

from __future__ import annotations

import fnmatch
import hashlib
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(path: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/{name}.parquet')")
    return con


def rows_of(pdf) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]
    out = []
    for r in pdf.itertuples(index=False, name=None):
        out.append(tuple("" if v is None or v != v else (repr(float(v)) if isinstance(v, (int, float)) else str(v)) for v in r))
    return sorted(out)


def digest(rows: list[tuple]) -> str:
    return hashlib.md5(repr(rows).encode()).hexdigest()


def main() -> int:
    import __spark_entry__ as entry

    from barloom.session import builder

    args = sys.argv[1:]
    path = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    names = list(entry.queries())
    if args:
        names = [n for n in names if any(fnmatch.fnmatch(n, a) for a in args)]
    spark = (
        builder("check").master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(path), []
    for n in names:
        t0 = time.time()
        try:
            got = rows_of(entry.queries()[n](spark, path).toPandas())
        except Exception as e:  # noqa: BLE001
            print(f"ERR   {n}: spark: {str(e)[:600]}", flush=True)
            bad.append(n)
            continue
        t1 = time.time()
        sql = entry.oracle_sql().get(n)
        if not sql:
            print(f"rows  {n}: {len(got)} ({t1 - t0:.1f}s)", flush=True)
            continue
        try:
            want = rows_of(con.execute(sql).df())
        except Exception as e:  # noqa: BLE001
            print(f"ERR   {n}: sql: {str(e)[:600]}", flush=True)
            bad.append(n)
            continue
        t2 = time.time()
        ok = digest(got) == digest(want)
        print(f"{'ok   ' if ok else 'DIFF '} {n}: {len(got)} / {len(want)} rows ({t1 - t0:.1f}s, sql {t2 - t1:.1f}s)", flush=True)
        if not ok:
            bad.append(n)
            a, b = set(got), set(want)
            print("   only spark:", sorted(a - b)[:3], len(a - b))
            print("   only sql:  ", sorted(b - a)[:3], len(b - a))
    print(f"{len(names) - len(bad)} of {len(names)} good; bad: {bad}")
    return bool(bad)


if __name__ == "__main__":
    sys.exit(main())

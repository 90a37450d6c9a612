"""python tests/verify.py [--sf 0.01] [NAME or PREFIX...]: compare queries with their SQL twins."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def compare(spark, con, name, fn, sql, directory):
    df = fn(spark, directory)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)
    if sql is None:
        return len(got), None, ""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return len(got), False, f"columns {cols} and {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    if got == want:
        return len(got), True, ""
    a, b = set(map(repr, got)), set(map(repr, want))
    return len(got), False, f"{len(got)} and {len(want)} rows; only in the query: {sorted(a - b)[:2]}; only in SQL: {sorted(b - a)[:2]}"


def connect(directory):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(directory):
        name = f.removesuffix(".parquet")
        path = os.path.join(directory, f)
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def main(args):
    sf = "0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    directory = sf if os.path.isdir(sf) else f"/root/testdata/sf{sf}"
    import __spark_entry__ as e

    from tallyloom.session import get_spark

    spark = get_spark("verify", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.driver.host": "127.0.0.1", "spark.ui.showConsoleProgress": "false"})
    con = connect(directory)
    queries, oracles = e.queries(), e.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if args and not any(name == a or name.startswith(a) for a in args):
            continue
        t = time.time()
        try:
            n, ok, why = compare(spark, con, name, fn, oracles.get(name), directory)
        except Exception as x:  # noqa: BLE001
            n, ok, why = -1, False, f"{type(x).__name__}: {str(x)[:700]}"
        bad += ok is False
        print(f"{'ok  ' if ok else '----' if ok is None else 'FAIL'} {name} {n} rows {time.time() - t:.1f}s {why}", flush=True)
    print(f"{bad} failed")
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

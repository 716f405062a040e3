"""Run queries against their SQL twins: python tests/check_queries.py [sf] [name-prefix ...] [-name-prefix ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 11) + 0.0
    return v


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(out, key=lambda r: tuple((x is not None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, con, fn, sql, sf):
    t0 = time.time()
    df = fn(spark, sf)
    rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return f"rows {len(rows)}", t1 - t0, 0.0
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    t2 = time.time()
    got_n, got = table(df.columns, rows)
    want_n, exp = table(names, want)
    if got_n != want_n:
        return f"COLUMNS {got_n} vs {want_n}", t1 - t0, t2 - t1
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    bad = [(n, t, types[n]) for n, t in df.dtypes if kinds.get(t) != types[n]]
    note = f" TYPES {bad}" if bad else ""
    if got != exp:
        diff = [(a, b) for a, b in zip(got, exp) if a != b][:2]
        return f"VALUES {len(got)} vs {len(exp)} {diff}{note}", t1 - t0, t2 - t1
    return f"ok {len(got)}{note}", t1 - t0, t2 - t1


def connect(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def main():
    import __spark_entry__ as e
    from regionmatch.session import build_session

    sf = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    wanted, sqls = [a for a in sys.argv[2:] if a[0] != "-"], e.oracle_sql()
    left_out = tuple(a[1:] for a in sys.argv[2:] if a[0] == "-")
    bad = 0
    for name, fn in e.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        if left_out and name.startswith(left_out):
            continue
        try:
            res, a, b = compare(spark, con, fn, sqls.get(name), sf)
        except Exception as exc:  # keep going, report at the end
            res, a, b = "ERROR " + str(exc).replace("\n", " ")[:400], 0, 0
        bad += not res.startswith(("ok", "rows")) or "TYPES" in res
        print(f"{name:28s} {a:6.2f}s {b:6.2f}s {res}", flush=True)
    print("bad", bad)
    spark.stop()


if __name__ == "__main__":
    main()

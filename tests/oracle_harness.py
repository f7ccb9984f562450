"""Run registered queries in Spark and their oracle SQL in DuckDB, compare results.

Mirrors the driver's gate: row count, column names, and an order-insensitive
comparison of values with columns sorted by name.
"""

from __future__ import annotations

import datetime as _dt
import decimal
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return ("f", round(v, 9))
    if isinstance(v, decimal.Decimal):
        return ("d", str(v))
    if isinstance(v, _dt.datetime):
        return ("ts", v.isoformat())
    if isinstance(v, _dt.date):
        return ("dt", v.isoformat())
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("i", v)
    return ("s", repr(v))


def compare(spark_df, con, sql):
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    rel = con.sql(sql)
    d_cols = rel.columns
    d_rows = rel.fetchall()
    problems = []
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"columns differ: spark={s_cols} duck={d_cols}")
        return problems, len(s_rows), len(d_rows)
    if len(s_rows) != len(d_rows):
        problems.append(f"row count spark={len(s_rows)} duck={len(d_rows)}")
    order = sorted(s_cols)
    si = [s_cols.index(c) for c in order]
    di = [d_cols.index(c) for c in order]
    sn = sorted(tuple(_norm(r[i]) for i in si) for r in s_rows)
    dn = sorted(tuple(_norm(r[i]) for i in di) for r in d_rows)
    if sn != dn:
        diff_s = [r for r in sn if r not in set(dn)][:3]
        diff_d = [r for r in dn if r not in set(sn)][:3]
        problems.append(f"values differ (cols {order}); spark-only {diff_s}; duck-only {diff_d}")
    return problems, len(s_rows), len(d_rows)


def main(argv):
    sys.path.insert(0, "..")
    from __spark_entry__ import oracle_sql, queries
    from tesoro.session import local_session_for_tests
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = set(argv[2:])
    spark = local_session_for_tests()
    con = duck(sf_dir)
    qs, sqls = queries(), oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t0 = time.time()
        df = fn(spark, sf_dir)
        if name not in sqls:
            n = df.count()
            print(f"{name:28s} rows={n} (no oracle) {time.time() - t0:.1f}s")
            continue
        problems, ns, nd = compare(df, con, sqls[name])
        status = "OK " if not problems else "BAD"
        bad += bool(problems)
        print(f"{status} {name:28s} rows={ns}/{nd} {time.time() - t0:.1f}s")
        for p in problems:
            print("     ", p[:1500])
    print("mismatches:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)

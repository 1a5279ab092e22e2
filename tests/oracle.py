"""Compare registered queries with their SQL twins in DuckDB."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return int(value) if value == int(value) else value
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(out, key=repr)


def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def compare(spark, con, folder, fn, sql):
    """None when equal, else a short text."""
    df = fn(spark, folder)
    got_names, got = rows_of(df.columns, df.collect())
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    want_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_names != want_names:
        return f"columns {got_names} / {want_names}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}; only here {sorted(set(got) - set(want), key=repr)[:2]}; only SQL {sorted(set(want) - set(got), key=repr)[:2]}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return None if not bad else f"{len(bad)} of {len(got)} rows differ, e.g. {bad[0]}"


def main():
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from conftest import session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = session(), duck(folder)
    names = sys.argv[1:] or list(entry.queries())
    sqls, fns, failed = entry.oracle_sql(), entry.queries(), []
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, folder, fns[name], sqls.get(name))
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        mark = "ok" if problem is None else "BAD"
        print(f"{mark:4}{time.time() - start:6.2f}s {name} {'(rows only) ' if name not in sqls else ''}{problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(names) - len(failed)} of {len(names)} ok; bad: {failed}")


if __name__ == "__main__":
    main()

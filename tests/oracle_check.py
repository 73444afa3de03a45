"""Run registered queries next to their checking SQL on one data folder and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import sys
import time

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def normal(value):
    if value is None:
        return ("0", "")
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, int):
        return ("i", value)
    if isinstance(value, float):
        return ("f", repr(value + 0.0))
    if isinstance(value, decimal.Decimal):
        return ("d", str(value))
    if isinstance(value, (datetime.date, datetime.datetime)):
        return ("t", str(value))
    return ("s", str(value))


def compare(spark, con, name, query, sql, folder):
    """(ok, message, seconds) of one query."""
    start = time.time()
    df = query(spark, folder)
    rows = df.collect()
    took = time.time() - start
    columns = sorted(df.columns)
    got = sorted(tuple(normal(r[c]) for c in columns) for r in rows)
    if sql is None:
        return None, f"{len(got)} rows, no SQL", took
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    if sorted(names) != columns:
        return False, f"columns {columns} != {sorted(names)}", took
    at = [names.index(c) for c in columns]
    want = sorted(tuple(normal(r[i]) for i in at) for r in result.fetchall())
    if got == want:
        return True, f"{len(got)} rows", took
    left, right = set(got) - set(want), set(want) - set(got)
    return False, f"rows {len(got)} vs {len(want)}; {columns}\n   spark only {len(left)}: {sorted(left)[:3]}\n   sql only {len(right)}: {sorted(right)[:3]}", took


def main(folder: str, only: list[str]) -> int:
    import __spark_entry__ as entry
    from wardflow.session import get_session

    spark = get_session("check", 8)
    con = connect(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad, total = [], 0.0
    for name, query in queries.items():
        if only and not any(name.startswith(o) for o in only):
            continue
        try:
            ok, message, took = compare(spark, con, name, query, oracle.get(name), folder)
        except Exception as error:  # noqa: BLE001 - report and go on
            ok, message, took = False, f"{type(error).__name__}: {str(error)[:600]}", 0.0
        total += took
        if ok is False:
            bad.append(name)
        print(f"{'ok ' if ok else '-- ' if ok is None else 'BAD'} {name} {took:.1f}s {message}", flush=True)
    print(f"{len(bad)} bad of {len(queries)}: {bad} total {total:.0f}s")
    return len(bad)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))

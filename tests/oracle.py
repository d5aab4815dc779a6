"""Compare registered queries with their SQL in DuckDB.

    python tests/oracle.py [folder] [query ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

def connect(sf_dir: str):
    connection = duckdb.connect()
    for file in sorted(os.listdir(sf_dir)):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{file}'")
    return connection


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        digits = int(os.environ.get("ORACLE_DIGITS", "12"))  # 17 compares doubles exactly
        return 0.0 if value == 0 else float(f"{value:.{digits}g}")
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(
        (tuple(plain(row[i]) for i in order) for row in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark, sf_dir: str, name: str, connection) -> tuple[bool, str]:
    from __spark_entry__ import oracle_sql, queries

    made = queries()[name](spark, sf_dir)
    got_names, got = table(made.columns, [tuple(r) for r in made.collect()])
    sql = oracle_sql().get(name)
    if sql is None:
        return len(got) > 0, f"{len(got)} rows, no SQL"
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    want_names, want = table(names, cursor.fetchall())
    if got_names != want_names:
        return False, f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return False, f"{len(got)} rows != {len(want)}"
    different = [(a, b) for a, b in zip(got, want) if a != b]
    if different:
        return False, f"{len(different)} of {len(got)} rows differ, {got_names}: {different[0]}"
    return True, f"{len(got)} rows equal"


if __name__ == "__main__":
    from txrisk.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    session = local_session("8")
    session.sparkContext.setLogLevel("OFF")
    from __spark_entry__ import queries

    duck = connect(folder)
    failed = []
    for query in sys.argv[2:] or list(queries()):
        began = time.time()
        try:
            ok, note = compare(session, folder, query, duck)
        except Exception as error:  # noqa: BLE001 - report and go on
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok  ' if ok else 'FAIL'} {query} {time.time() - began:.1f}s {note}", flush=True)
        if not ok:
            failed.append(query)
    print(f"{len(failed)} failed: {failed}")
    sys.exit(bool(failed))

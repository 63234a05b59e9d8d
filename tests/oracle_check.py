"""Compare registered queries with their SQL twins: ``python tests/oracle_check.py [sf_dir] [name ...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _cell(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(round(value, 6) + 0.0)
    if isinstance(value, int):
        return repr(float(value))
    if type(value).__name__ == "Decimal":
        return repr(round(float(value), 6) + 0.0)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def compare(spark, con, sf_dir, query, sql) -> tuple[bool | None, str]:
    """Whether the rows agree (None: there is no SQL to compare with), and what was seen."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None, f"{len(got)} rows, no SQL"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} / {sorted(names)}"
    if got != want:
        have, need = set(got), set(want)
        only_got, only_want = sorted(have - need)[:3], sorted(need - have)[:3]
        return False, f"{len(got)} / {len(want)} rows\n   spark {str(only_got)[:900]}\n   sql   {str(only_want)[:900]}"
    return True, f"{len(got)} rows"


def main() -> int:
    import __spark_entry__ as e
    from cuelog.session import build_session
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                         "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(sf_dir), e.oracle_sql(), 0
    for name, query in e.queries().items():
        if args and name not in args:
            continue
        begin = time.time()
        try:
            ok, text = compare(spark, con, sf_dir, query, sql.get(name))
        except Exception as exc:  # report and go on with the next query
            ok, text = False, f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += ok is False
        print(f"{'none' if ok is None else 'ok  ' if ok else 'FAIL'} {name:32s} {time.time() - begin:6.2f}s {text}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)

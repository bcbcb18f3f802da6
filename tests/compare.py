"""Compare registered queries with their SQL: ``python -m tests.compare [folder] [names...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(value + 0.0)
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted(tuple(_cell(r[k]) for k in order) for r in rows)


def difference(df, con, sql):
    """Empty text when both sides agree, else what differs first."""
    got = [tuple(r) for r in df.collect()]
    cursor = con.execute(sql)
    want_names, want = [d[0] for d in cursor.description], cursor.fetchall()
    gn, gr = rows_of(df.columns, got)
    wn, wr = rows_of(want_names, want)
    if gn != wn:
        return f"columns {gn} / {wn}"
    if len(gr) != len(wr):
        return f"rows {len(gr)} / {len(wr)}"
    for a, b in zip(gr, wr):
        if a != b:
            bad = sum(x != y for x, y in zip(gr, wr))
            return f"{bad} of {len(gr)} differ: {a} / {b}"
    gk = {f.name: TYPES.get(f.dataType.simpleString()) for f in df.schema.fields}
    wk = {r[0]: r[1] for r in con.execute("DESCRIBE " + sql).fetchall()}
    return "" if gk == wk else f"types {gk} / {wk}"


def main(argv):
    from lamina.session import get_session
    import __spark_entry__ as entry

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    spark = get_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(folder), 0
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in argv[1:] or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            verdict = difference(df, con, oracles[name]) if name in oracles else f"(no sql, {df.count()} rows)"
        except Exception as error:  # report and go on
            verdict = f"{type(error).__name__}: {str(error)[:700]}"
        failed += bool(verdict) and not verdict.startswith("(no sql")
        print(f"{time.time() - start:6.2f}s {name}: {verdict or 'ok'}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main(sys.argv[1:])

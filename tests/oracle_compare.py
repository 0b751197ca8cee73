"""Run a registered query in Spark and its oracle SQL in DuckDB; compare results.

Comparison: row count, column names, and the multiset of rows after sorting
columns by name and normalising values (timestamps to ISO text, floats to 9
significant digits, NULL to a marker).
"""

from __future__ import annotations

import math
import sys
from datetime import date, datetime

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "<NULL>"
    if isinstance(v, float):
        if math.isnan(v):
            return "<NULL>"
        return f"{v:.9g}"
    if isinstance(v, datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, date):
        return v.isoformat()
    if isinstance(v, bool):
        return str(v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


# Spark simple type -> DuckDB type name, for the schema part of the comparison.
TYPE_MAP = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP",
            "boolean": "BOOLEAN", "double": "DOUBLE"}


def compare(spark, con, name, fn, sql, sf_dir):
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_types = {f.name: TYPE_MAP.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in sdf.schema.fields}
    s_rows = [tuple(r) for r in sdf.collect()]
    d_types = {c: str(t) for c, t in zip(*(lambda r: (r.columns, r.types))(con.sql(sql)))}
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    problems = []
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"columns differ: spark={s_cols} duck={d_cols}")
    elif s_types != d_types:
        problems.append(f"types differ: {[(c, s_types[c], d_types[c]) for c in s_cols if s_types[c] != d_types[c]]}")
    if len(s_rows) != len(d_rows):
        problems.append(f"row count spark={len(s_rows)} duck={len(d_rows)}")
    if not problems:
        a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
        if a != b:
            diff = [x for x in a if x not in set(b)][:3]
            problems.append(f"values differ, e.g. spark-only {diff}")
    return len(s_rows), problems


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import time
    from grantlens import build_session
    import __spark_entry__ as E
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:] or None
    spark = build_session("local[8]", 8, extra={"spark.ui.showConsoleProgress": "false"})
    con = duck(sf_dir)
    qs, oracle = E.queries(), E.oracle_sql()
    bad = 0
    for name in qs:
        if only and name not in only:
            continue
        t = time.time()
        try:
            if name not in oracle:
                n = qs[name](spark, sf_dir).count()
                print(f"NOORACLE {name}: rows={n}")
                continue
            n, problems = compare(spark, con, name, qs[name], oracle[name], sf_dir)
        except Exception as exc:  # report and continue
            problems, n = [f"error: {type(exc).__name__}: {str(exc)[:600]}"], -1
        status = "OK " if not problems else "BAD"
        bad += bool(problems)
        print(f"{status} {name}: rows={n} {time.time() - t:.1f}s {'; '.join(problems)}", flush=True)
    print("failures:", bad)

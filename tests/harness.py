"""Run registered queries against DuckDB on the same parquet files."""

from __future__ import annotations

import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
          "boolean": "BOOLEAN"}


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v + 0.0:.9g}"
    return str(v)


def compare(spark, con, fn, sql, sf):
    """Return (n_rows, list of problems)."""
    df = fn(spark, sf)
    cols = sorted(df.columns)
    got_t = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    if sql is None:
        return len(got), []
    rel = con.sql(sql)
    problems = []
    if sorted(rel.columns) != cols:
        return len(got), [f"columns {cols} vs {sorted(rel.columns)}"]
    ex_t = dict(zip(rel.columns, map(str, rel.types)))
    for c in cols:
        if _TYPES.get(got_t[c]) != ex_t[c]:
            problems.append(f"type of {c}: {got_t[c]} vs {ex_t[c]}")
    pos = [rel.columns.index(c) for c in cols]
    exp = [tuple(r[i] for i in pos) for r in rel.fetchall()]
    a = sorted(tuple(map(norm, r)) for r in got)
    b = sorted(tuple(map(norm, r)) for r in exp)
    if a != b:
        sa, sb = set(a) - set(b), set(b) - set(a)
        problems.append(f"rows {len(a)} vs {len(b)}; only spark {sorted(sa)[:3]}; only duck {sorted(sb)[:3]}; cols {cols}")
    return len(got), problems


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as e
    from cellshift.session import build_session

    spark = build_session("check", 8)
    spark.sparkContext.setLogLevel("ERROR")
    if "MAX_GROUP_ROWS" in os.environ:  # small values force the sliced ranking everywhere
        spark.conf.set("spark.cellshift.maxGroupRows", os.environ["MAX_GROUP_ROWS"])
    sf = "/root/testdata/sf0.01"
    con = duck(sf)
    qs, os_ = e.queries(), e.oracle_sql()
    keys = [k for k in qs if not argv or any(k.startswith(a) for a in argv)]
    bad = 0
    for k in keys:
        t = time.time()
        try:
            n, problems = compare(spark, con, qs[k], os_.get(k), sf)
        except Exception as ex:  # keep going: report every key
            n, problems = 0, [f"{type(ex).__name__}: {str(ex)[:700]}"]
        dt = time.time() - t
        flag = "ok " if not problems else "BAD"
        bad += bool(problems)
        if problems or dt > 4 or n == 0:
            print(f"{flag} {k} rows={n} {dt:.1f}s {'oracle' if k in os_ else 'rows-only'} {problems}", flush=True)
    print(f"{len(keys)} keys, {bad} bad")


if __name__ == "__main__":
    main(sys.argv[1:])

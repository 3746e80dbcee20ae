"""Run registered queries in Spark and their oracle SQL in DuckDB and compare.

Comparison: same column names, same row count, and equal multisets of rows
after normalising values (floats to 9 significant digits, decimals to float,
dates and timestamps to text).
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys

import duckdb

HERE = os.path.dirname(os.path.abspath(__file__))
ROOT = os.path.dirname(HERE)
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm_value(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, (dt.datetime, dt.date, dt.time)):
        return str(v)
    if isinstance(v, bool):
        return bool(v)
    if isinstance(v, int):
        return int(v)
    return str(v)


def rows_key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark, name, fn, sql, sf_dir, con=None):
    con = con or duck(sf_dir)
    sdf = fn(spark, sf_dir)
    scols = sdf.columns
    srows = [tuple(norm_value(r[c]) for c in scols) for r in sdf.collect()]
    rel = con.sql(sql)
    ocols = list(rel.columns)
    otypes = {c.lower(): str(t) for c, t in zip(ocols, rel.types)}
    orows_raw = rel.fetchall()
    problems = []
    from schema_compare import spark_type
    stypes = {f.name.lower(): spark_type(f.dataType) for f in sdf.schema.fields}
    tdiff = {c: (stypes[c], otypes.get(c)) for c in stypes if stypes[c] != otypes.get(c)}
    if tdiff:
        problems.append(f"types differ: {tdiff}")
    if sorted(c.lower() for c in scols) != sorted(c.lower() for c in ocols):
        problems.append(f"columns differ: spark={scols} oracle={ocols}")
        return problems, len(srows), len(orows_raw)
    idx = [[c.lower() for c in ocols].index(c.lower()) for c in scols]
    orows = [tuple(norm_value(r[i]) for i in idx) for r in orows_raw]
    if len(srows) != len(orows):
        problems.append(f"row count spark={len(srows)} oracle={len(orows)}")
    a, b = rows_key(srows), rows_key(orows)
    if a != b:
        sa, sb = set(a), set(b)
        only_s = [r for r in a if r not in sb][:3]
        only_o = [r for r in b if r not in sa][:3]
        problems.append(f"values differ; spark-only={only_s} oracle-only={only_o}")
    return problems, len(srows), len(orows)


def main(argv):
    import time
    from cabmart.session import local_session
    import __spark_entry__ as E
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    names = argv or list(E.queries())
    spark = local_session(8)
    con = duck(sf_dir)
    qs, sq = E.queries(), E.oracle_sql()
    bad = 0
    for n in names:
        t0 = time.time()
        if n not in sq:
            print(f"{n}: no oracle")
            continue
        try:
            probs, ns, no = compare(spark, n, qs[n], sq[n], sf_dir, con)
        except Exception as e:  # report and go on
            probs, ns, no = [f"ERROR {type(e).__name__}: {str(e)[:400]}"], -1, -1
        status = "OK " if not probs else "BAD"
        bad += bool(probs)
        print(f"{status} {n} rows={ns}/{no} {time.time() - t0:.1f}s {'; '.join(probs)}", flush=True)
    print(f"{len(names) - bad}/{len(names)} match")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)

"""Compare result column types of every registered query with its DuckDB oracle."""

from __future__ import annotations

import os
import sys

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
sys.path.insert(0, HERE)

from oracle_compare import duck  # noqa: E402

SPARK = {"int": "INTEGER", "smallint": "SMALLINT", "bigint": "BIGINT", "double": "DOUBLE",
         "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
         "float": "FLOAT", "tinyint": "TINYINT"}


def spark_type(t) -> str:
    s = t.simpleString()
    if s.startswith("decimal"):
        return s.upper()
    return SPARK.get(s, s.upper())


def main(argv):
    from cabmart.session import local_session
    import __spark_entry__ as E
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
    spark = local_session(8)
    con = duck(sf)
    names = argv or list(E.queries())
    bad = 0
    for n in names:
        sdf = E.queries()[n](spark, sf)
        st = {f.name.lower(): spark_type(f.dataType) for f in sdf.schema.fields}
        rel = con.sql(E.oracle_sql()[n])
        dt = {c.lower(): str(t) for c, t in zip(rel.columns, rel.types)}
        diff = {c: (st.get(c), dt.get(c)) for c in set(st) | set(dt) if st.get(c) != dt.get(c)}
        if diff:
            bad += 1
            print(f"TYPES {n}: {diff}", flush=True)
    print(f"TYPES done, {bad} queries differ", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])

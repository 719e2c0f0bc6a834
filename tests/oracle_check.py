"""Compare each registered query with its DuckDB SQL (local twin of the
driver's correctness gate): row count, column names, and the multiset of
rows with floats rounded to 9 places.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time
from collections import Counter

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


STRICT = os.environ.get("ORACLE_STRICT") == "1"


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0 if STRICT else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    return v


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(norm(x) for x in r) for r in sdf.collect()]
    t1 = time.time()
    if sql is None:
        return dict(name=name, ok=None, rows=len(s_rows), sec=round(t1 - t0, 2), note="no oracle")
    rel = con.execute(sql)
    d_cols = [d[0] for d in rel.description]
    d_types = dict(zip(d_cols, [str(d[1]) for d in rel.description]))
    type_map = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "float": "FLOAT"}
    s_types = {f.name: type_map.get(f.dataType.simpleString(), f.dataType.simpleString())
               for f in sdf.schema.fields}
    bad_types = {c: (s_types[c], d_types.get(c)) for c in s_cols
                 if c in d_types and s_types[c] != d_types[c]}
    d_rows = [tuple(norm(x) for x in r) for r in rel.fetchall()]
    res = dict(name=name, rows=len(s_rows), oracle_rows=len(d_rows), sec=round(t1 - t0, 2))
    if sorted(s_cols) != sorted(d_cols):
        res.update(ok=False, note=f"columns {s_cols} vs {d_cols}")
        return res
    order = [d_cols.index(c) for c in s_cols]
    d_rows = [tuple(r[i] for i in order) for r in d_rows]
    cs, cd = Counter(s_rows), Counter(d_rows)
    if cs == cd:
        res.update(ok=True)
        if bad_types:
            res.update(types=bad_types)
    else:
        only_s = list((cs - cd).elements())[:3]
        only_d = list((cd - cs).elements())[:3]
        res.update(ok=False, note=f"spark-only {only_s} oracle-only {only_d}")
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as E
    from ratewise.session import local_session
    spark = local_session(cpus=8, shuffle_partitions=8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name in names or list(qs):
        try:
            r = compare(spark, con, name, qs[name], sqls.get(name), sf_dir)
        except Exception as e:  # report and go on
            r = dict(name=name, ok=False, note=f"{type(e).__name__}: {str(e)[:400]}")
        bad += r.get("ok") is False
        print(r, flush=True)
    print(f"{len(names or qs)} queries, {bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))

"""Run registered queries on Spark and their SQL on DuckDB and compare the rows.

python tests/oracle_check.py [sf] [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import tempfile
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(v + 0.0)
    if isinstance(v, decimal.Decimal):
        return "dec:" + str(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return repr(v) if not isinstance(v, (datetime.date,)) else str(v)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    left = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    t1 = time.time()
    if sql is None:
        return "rows-only", f"{len(left)} rows", t1 - t0, 0
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    data = cur.fetchall()
    t2 = time.time()
    if sorted(names) != cols:
        return "FAIL", f"columns {cols} vs {sorted(names)}", t1 - t0, t2 - t1
    idx = [names.index(c) for c in cols]
    right = sorted((tuple(norm(r[i]) for i in idx) for r in data), key=repr)
    if left == right:
        return ("ok" if left else "EMPTY"), f"{len(left)} rows", t1 - t0, t2 - t1
    if len(left) != len(right):
        extra = [x for x in left if x not in set(right)][:2]
        missing = [x for x in right if x not in set(left)][:2]
        return "FAIL", f"rows {len(left)} vs {len(right)} cols {cols}; only spark {extra}; only duckdb {missing}", t1 - t0, t2 - t1
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    return "FAIL", f"{len(bad)} of {len(left)} rows differ; cols {cols}; first {bad[:2]}", t1 - t0, t2 - t1


def main(argv):
    import duckdb

    import __spark_entry__ as entry
    from probeweave.session import build_session

    sf = argv[0] if argv else "0.01"
    only = argv[1:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": f"file://{tempfile.mkdtemp(prefix='oracle-')}"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    queries, sql = entry.queries(), entry.oracle_sql()
    unknown = set(sql) - set(queries)
    assert not unknown, unknown
    bad = 0
    for name, fn in queries.items():
        if only and not any(name == o or (o.endswith("*") and name.startswith(o[:-1])) for o in only):
            continue
        try:
            status, note, a, b = compare(spark, con, name, fn, sql.get(name), sf_dir)
        except Exception as exc:  # report and go on with the next query
            status, note, a, b = "ERROR", str(exc)[:1500], 0, 0
        if status in ("FAIL", "ERROR", "EMPTY"):
            bad += 1
        print(f"{status:9s} {name:40s} spark {a:6.2f}s duckdb {b:6.2f}s {note}", flush=True)
    print("problems:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)

"""Run registered queries next to their SQL text and compare the rows: python check.py [name ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb

from tidemark.catalog import QUERIES
from tidemark.session import build

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def norm(v):
        if hasattr(v, "asDict"):
            v = tuple(v)
        if isinstance(v, dict):
            v = tuple(v.values())
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(norm(x) for x in v) + "]"
        if isinstance(v, float):
            return repr(v + 0.0)
        return str(v)
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def main(names, sf):
    spark = build("check", f"local[{os.environ.get('BENCH_CPUS', '8')}]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = []
    for name in names or QUERIES:
        q = QUERIES[name]
        start = time.time()
        try:
            df = q.run(spark, sf)
            got = rows_of(df.columns, df.collect())
            took = time.time() - start
            if q.sql is None:
                print(f"rows  {name}: {len(got)} rows {took:.1f}s", flush=True)
                continue
            cur = con.execute(q.sql)
            cols = [d[0] for d in cur.description]
            want = rows_of(cols, cur.fetchall())
            if sorted(cols) != sorted(df.columns):
                bad.append(name)
                print(f"COLS  {name}: {sorted(df.columns)} vs {sorted(cols)}", flush=True)
            elif got != want:
                bad.append(name)
                print(f"DIFF  {name}: {len(got)} vs {len(want)} rows, columns {sorted(cols)}", flush=True)
                gs, ws = set(got), set(want)
                print("   spark:", [r for r in got if r not in ws][:3])
                print("   sql:  ", [r for r in want if r not in gs][:3], flush=True)
            else:
                print(f"ok    {name}: {len(got)} rows {took:.1f}s", flush=True)
        except Exception as e:
            bad.append(name)
            print(f"FAIL  {name}: {type(e).__name__} {str(e)[:900]}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:], os.environ.get("CHECK_SF", "/root/testdata/sf0.01")))

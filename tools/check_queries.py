"""Run registered queries against their SQL in DuckDB and report differences.

usage: python tools/check_queries.py <folder> [module | :query ...]
"""

from __future__ import annotations

import importlib
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from quire.plans.registry import MODULES  # noqa: E402

# EXACT=1 compares doubles to the last bit.
EXACT = os.environ.get("EXACT") == "1"
TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('CPUS', '8')}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v + 0.0) if EXACT else f"{v:.6g}"
        if isinstance(v, bool):
            return str(v)
        return str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def main(folder, wanted):
    spark = session()
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = 0
    for module in MODULES:
        if wanted and module not in wanted and not any(":" in w for w in wanted):
            continue
        for name, (run, sql) in importlib.import_module(f"quire.plans.{module}_queries").QUERIES.items():
            if any(":" in w for w in wanted) and f":{name}" not in wanted:
                continue
            t = time.time()
            try:
                df = run(spark, folder)
                got = [tuple(r) for r in df.collect()]
            except Exception as err:
                bad += 1
                print(f"FAIL {name}: {str(err)[:1500]}", flush=True)
                continue
            took = time.time() - t
            if sql is None:
                print(f"rows {name}: {len(got)} {took:.1f}s", flush=True)
                continue
            t = time.time()
            try:
                cur = db.execute(sql)
                names = [d[0] for d in cur.description]
                want = cur.fetchall()
            except Exception as err:
                bad += 1
                print(f"SQL  {name}: {str(err)[:1500]}", flush=True)
                continue
            a, b = canonical(got, df.columns), canonical(want, names)
            same = sorted(df.columns) == sorted(names) and a == b
            bad += not same
            print(
                f"{'ok  ' if same else 'DIFF'} {name}: {len(a)} rows, spark {took:.1f}s, sql {time.time()-t:.1f}s",
                flush=True,
            )
            if not same:
                print("   columns", sorted(df.columns), sorted(names), len(a), len(b))
                sa, sb = set(a), set(b)
                print("   spark only", [str(x)[:400] for x in list(sa - sb)[:3]])
                print("   sql only  ", [str(x)[:400] for x in list(sb - sa)[:3]])
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])

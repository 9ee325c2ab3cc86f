"""Run registered queries next to their SQL in DuckDB and report differences.

usage: python tools/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import importlib.util
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


SAME_TYPE = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def load_entry():
    spec = importlib.util.spec_from_file_location("__spark_entry__", f"{ROOT}/__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return repr(value)


def table_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, fn, sql, sf_dir):
    """(rows, seconds, problem or None)."""
    start = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return len(got), took, None
    rel = con.sql(sql)
    want = rel.fetchall()
    if sorted(df.columns) != sorted(rel.columns):
        return len(got), took, f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    duck_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    odd = [(f.name, f.dataType.simpleString(), duck_types[f.name]) for f in df.schema.fields
           if SAME_TYPE.get(f.dataType.simpleString()) != duck_types[f.name]]
    if odd:
        return len(got), took, f"types {odd}"
    a, b = table_rows(df.columns, got), table_rows(rel.columns, want)
    if len(a) != len(b):
        return len(got), took, f"rows {len(a)} != {len(b)}: {str(a[:2])[:300]} // {str(b[:2])[:300]}"
    for x, y in zip(a, b):
        if x != y:
            return len(got), took, f"spark {str(x)[:500]}\n        duck  {str(y)[:500]}"
    return len(got), took, None


def main() -> int:
    from sievewright import build_session
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:]
    if os.environ.get("PLAIN_SESSION"):
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").getOrCreate()
    else:
        spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("OFF")
    entry, con, bad = load_entry(), duck(sf_dir), 0
    oracles = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if names and not any(n == name or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        try:
            rows, took, problem = compare(spark, con, fn, oracles.get(name), sf_dir)
        except Exception as exc:
            rows, took, problem = 0, 0.0, f"{type(exc).__name__}: {str(exc)[:1500]}"
        mark = "BAD " if problem else ("ok  " if name in oracles else "rows")
        print(f"{mark} {name:26s} rows={rows:6d} {took:6.2f}s {problem or ''}", flush=True)
        bad += problem is not None
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())

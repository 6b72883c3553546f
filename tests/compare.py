"""Run registered queries next to their SQL oracles and compare rows as sorted values."""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def spark_session(cores: str = "8"):
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("siteloom-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _value(v):
    if v is None:
        return "~null"
    if isinstance(v, bool):
        return f"b:{v}"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"f:{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"d:{v}"
    if isinstance(v, int):
        return f"i:{v}"
    if isinstance(v, dt.datetime):
        return f"t:{v.replace(tzinfo=None).isoformat()}"
    return f"s:{v}"


def compare(spark, con, name, run, sql, folder):
    df = run(spark, folder)
    cols = sorted(df.columns)
    t0 = time.time()
    got = sorted(tuple(_value(r[c]) for c in cols) for r in df.collect())
    took = time.time() - t0
    if sql is None:
        return ("rows-only", len(got), took, "")
    rel = con.sql(sql)
    names = rel.columns
    want_cols = sorted(names)
    if want_cols != cols:
        return ("COLUMNS", len(got), took, f"spark={cols} duck={want_cols}")
    idx = [names.index(c) for c in cols]
    want = sorted(tuple(_value(r[i]) for i in idx) for r in rel.fetchall())
    if got == want:
        return ("ok", len(got), took, "")
    have, need = set(got), set(want)
    only_s = [r for r in got if r not in need][:2]
    only_d = [r for r in want if r not in have][:2]
    return ("DIFF", len(got), took, f"cols={cols}\n   duck rows={len(want)}\n   spark only: {str(only_s)[:900]}\n   duck only:  {str(only_d)[:900]}")


def main():
    import __spark_entry__ as entry

    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*")
    ap.add_argument("--dir", default="/root/testdata/sf0.01")
    ap.add_argument("--skip", default="")
    a = ap.parse_args()
    spark = spark_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(a.dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, run in qs.items():
        if name in a.skip.split(","):
            continue
        if a.names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in a.names):
            continue
        try:
            status, rows, took, note = compare(spark, con, name, run, sqls.get(name), a.dir)
        except Exception as e:  # noqa: BLE001
            status, rows, took, note = "ERROR", -1, 0.0, str(e)[:1500]
        bad += status not in ("ok", "rows-only")
        print(f"{status:9} {name:32} rows={rows:<6} {took:5.1f}s {note}", flush=True)
    print("problems:", bad)


if __name__ == "__main__":
    main()

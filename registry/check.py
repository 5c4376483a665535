"""Run ready queries in Spark and their check SQL in DuckDB, and compare: ``python -m registry.check [sf] [names…]``."""

from __future__ import annotations

import math
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _cell(v):
    if v is None or v != v:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return v
    if isinstance(v, int):
        return v
    return str(v)


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(_cell(r[i]) for i in order) for r in records]
    key = lambda r: tuple((x is None, str(type(x).__name__ if not isinstance(x, (int, float)) else "n"),
                           f"{x:.4g}" if isinstance(x, float) else str(x)) for x in r)
    return [columns[i] for i in order], sorted(rows, key=key)


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1.5e-6)
    return a == b and isinstance(a, bool) == isinstance(b, bool) and (type(a) is type(b))


def compare(spark_cols, spark_rows, duck_cols, duck_rows):
    """(verdict, detail); ``exact`` also holds for the last bit of every double."""
    c1, r1 = rows_of(spark_cols, spark_rows)
    c2, r2 = rows_of(duck_cols, duck_rows)
    if c1 != c2:
        return "COLUMNS", f"{c1} vs {c2}"
    if len(r1) != len(r2):
        return "ROWS", f"{len(r1)} vs {len(r2)}"
    if r1 == r2 and all(type(x) is type(y) for a, b in zip(r1, r2) for x, y in zip(a, b)):
        return "exact", len(r1)
    bad = [(a, b) for a, b in zip(r1, r2) if not all(same(x, y) for x, y in zip(a, b))]
    if bad:
        return "VALUES", f"{len(bad)} of {len(r1)} rows, e.g. {c1}\n   spark {bad[0][0]}\n   duck  {bad[0][1]}"
    loose = sum(a != b for a, b in zip(r1, r2))
    return "close", f"{len(r1)} rows, {loose} differ in the last digit"


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def run_check(spark, con, entry, sf_dir):
    t0 = time.time()
    df = entry.run(spark, sf_dir)
    records = df.collect()
    t1 = time.time()
    sql = entry.oracle()
    if sql is None:
        return "no sql", f"{len(records)} rows", t1 - t0
    con.execute(sql)
    duck_cols = [d[0] for d in con.description]
    verdict, detail = compare(df.columns, records, duck_cols, con.fetchall())
    return verdict, detail, t1 - t0


def main(argv):
    from pyspark.sql import SparkSession
    from registry.catalog import ENTRIES
    sf = argv[0] if argv else "0.01"
    names = argv[1:] or list(ENTRIES)
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = duck(sf_dir)
    failed = 0
    for name in [n for n in ENTRIES if any(n == w or (w.endswith("*") and n.startswith(w[:-1])) for w in names)]:
        try:
            verdict, detail, seconds = run_check(spark, con, ENTRIES[name], sf_dir)
        except Exception as exc:  # noqa: BLE001
            verdict, detail, seconds = "ERROR", f"{type(exc).__name__}: {str(exc)[:700]}", 0.0
        failed += verdict in ("ERROR", "VALUES", "ROWS", "COLUMNS")
        print(f"{verdict:8} {name:34} {seconds:6.2f}s  {detail}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])

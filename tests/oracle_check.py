"""Run registered queries against their SQL counterparts: python tests/oracle_check.py [sf_dir] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.10g}") + 0.0
    if isinstance(v, int):
        return float(v)
    return v


def rows(df: pd.DataFrame) -> list[tuple]:
    names = sorted(df.columns)
    out = [tuple(_plain(v) for v in r) for r in df[names].itertuples(index=False, name=None)]
    return sorted(out, key=lambda r: [(v is None, str(v)) for v in r])


def compare(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str | None:
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(set(spark_df.columns) ^ set(sql_df.columns))}"
    a, b = rows(spark_df), rows(sql_df)
    if len(a) != len(b):
        return f"row count {len(a)} against {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        names = sorted(spark_df.columns)
        x, y = bad[0]
        diff = {n: (p, q) for n, p, q in zip(names, x, y) if p != q}
        return f"{len(bad)} rows differ, first {diff}"
    return None


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = database(sf_dir)
    oracles = entry.oracle_sql()
    failed = []
    for name, q in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            got = q(spark, sf_dir).toPandas()
            took = time.time() - start
            if name not in oracles:
                problem = f"rows only: {len(got)}"
            else:
                problem = compare(got, con.sql(oracles[name]).df())
                if problem:
                    failed.append(name)
        except Exception as e:  # noqa: BLE001
            took = time.time() - start
            problem = f"{type(e).__name__}: {str(e)[:600]}"
            failed.append(name)
        print(f"{'ok  ' if problem is None else '??  '}{name:28s} {took:6.2f}s  {problem or len(got)}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()

"""Time the registered queries: one JSON line on stdout.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. The shared steps that later queries read
(deriving the report, scoring it, the nearest-peer table) are timed as entries of their own.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    from orgpulse.plans import fixture, queries
    from orgpulse.staging import forget

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    steps = {
        "stage_report": lambda: fixture.report(spark, sf_dir),
        "stage_enriched": lambda: fixture.enriched(spark, sf_dir),
        "stage_proportions": lambda: queries.proportions(spark, sf_dir),
        "stage_cloud_peers": lambda: queries.peers(spark, sf_dir),
    }

    def run(q):
        return lambda: q(spark, sf_dir).write.format("noop").mode("overwrite").save()

    forget(sf_dir)
    times: dict[str, float] = {}
    for name, step in {**steps, **{n: run(q) for n, q in queries.QUERIES.items()}}.items():
        start = time.perf_counter()
        step()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total wall time of all registered queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rsplit("/sf", 1)[-1],
            }
        ),
        flush=True,
    )


if __name__ == "__main__":
    main()

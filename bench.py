"""Times headline queries, one warm-up then the median of three, with DuckDB on the same files beside it, and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time
from collections.abc import Callable

from pyspark.sql import SparkSession

from switchyard import catalogue

HEADLINE = ["rates_shrunk_success", "rates_backed_off", "split_softmax", "impact_by_cell", "forecast_tails", "forecast_origin_lock", "allocation_after", "projection_two_cohort", "extract_risk_a", "report_by_mid", "projection_granular", "stream_windowed_counts"]


TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def median_of(run: Callable[[], object], times: int = 3) -> float:
    took = []
    for _ in range(times + 1):  # the first run warms up
        began = time.time()
        run()
        took.append(time.time() - began)
    return round(statistics.median(took[1:]), 3)


def duckdb_times(sf_dir: str, cpus: int) -> dict[str, float]:
    """The same queries by their SQL twins."""
    import duckdb

    connection, sql = duckdb.connect(config={"threads": cpus}), catalogue.oracle_sql()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return {name: median_of(lambda text=sql[name]: connection.execute(text).fetchall()) for name in HEADLINE if name in sql}


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = catalogue.queries(), {}
    for name in HEADLINE:
        times[name] = median_of(lambda query=queries[name]: query(spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "duckdb": duckdb_times(sf_dir, int(cpus))}))
    spark.stop()


if __name__ == "__main__":
    main()

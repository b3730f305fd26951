"""Times the headline queries on local[BENCH_CPUS] over BENCH_SF_DIR and prints one JSON line: warm, median of three, with input rows a second.

``decode_records_s`` is the rate of the packed-record decoder over a buffer of some MB, in one thread.
"""

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import pandas as pd  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from tickloom.plans.queries import QUERIES  # noqa: E402
from tickloom.sources import codec  # noqa: E402

NAMES = ["ohlc_1m", "bar_variances", "bar_drift", "ohlc_rollup", "l1_accumulate", "last_per_ticker", "vol_30m_ema", "vol_mtf_blend", "renko_bricks", "renko_per_day", "delta_gate", "composite_tdwap", "synth_asof", "synth_ohlc", "rolling_rho", "daily_ohlc", "descriptive"]
RUNS = 3


def decode_rate() -> int:
    n = 200_000
    data = codec.encode("idx", pd.DataFrame({"mts": range(n), "ticker": 1, "bid": 1.0, "ask": 2.0}))
    runs = []
    for _ in range(RUNS):
        began = time.time()
        codec.decode("idx", data)
        runs.append(time.time() - began)
    return round(n / statistics.median(runs))


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    rows = {"daily_ohlc": spark.read.parquet(f"{sf}/lineitem.parquet").count()}
    events = spark.read.parquet(f"{sf}/events.parquet").count()
    took = {}
    for name in NAMES:
        runs = []
        for _ in range(RUNS + 1):  # the first one warms up
            began = time.time()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(statistics.median(runs[1:]), 3)
    spark.stop()
    rate = {n: round(rows.get(n, events) / t) for n, t in took.items()}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "rows_per_s": rate, "decode_records_s": decode_rate(), "sf": Path(sf).name}))


if __name__ == "__main__":
    main()

"""Time headline queries at $BENCH_SF_DIR and the replay streams; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.operators.metrics import EventWindow
from tidegate.plans import catalog, experiment
from tidegate.session import RECOMMENDED, new_path
from tidegate.sources import replay

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPLAY_ROWS = [int(n) for n in os.environ.get("BENCH_REPLAY", "100000,1000000,10000000").split(",") if n]
HEADLINE = [
    "policy_metrics",
    "gate_counts_by_symbol",
    "debounce_dynamic",
    "process_results",
    "process_results_bucketed",
    "oco_trigger",
    "oco_replaced_triggers",
    "latency_percentiles",
    "price_percentiles",
    "message_report",
    "payload_check",
    "store_and_audit",
    "gap_grid_pivot",
    "kv_log",
    "frame_roundtrip",
]


def session() -> SparkSession:
    builder = SparkSession.builder.master(f"local[{CPUS}]").appName("tidegate-bench")
    settings = {
        **RECOMMENDED,
        "spark.sql.shuffle.partitions": CPUS,
        "spark.driver.memory": "16g",
        "spark.ui.enabled": "false",
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(build) -> float:
    """Seconds from building the query to its last row."""
    start = time.perf_counter()
    result = build()
    if isinstance(result, DataFrame):
        result.write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def compare(spark: SparkSession, rows: int):
    stream = replay.inject_faults(replay.replay_ticks(spark, rows))
    return experiment.compare_policies(
        stream,
        experiment.replay_orders(spark),
        window=EventWindow.after_switch(rows),
        probe_mid=replay.CRASH_PRICE,
    )


def raw(spark: SparkSession, rows: int):
    return experiment.raw_pipeline(replay.raw_replay(spark, rows), experiment.replay_orders(spark))


def store(spark: SparkSession, rows: int):
    stream = replay.inject_faults(replay.replay_ticks(spark, rows))
    stream = stream.withColumn("sequence", F.col("arrival"))
    return experiment.store_and_audit(stream, new_path(spark, "ticks"))


def main() -> None:
    spark = session()
    every = catalog.QUERIES
    for name in HEADLINE:  # discarded warm-up on the smallest tables
        timed(lambda: every[name](spark, os.path.join(os.path.dirname(SF_DIR), "sf0.001")))
    times = {name: timed(lambda: every[name](spark, SF_DIR)) for name in HEADLINE}
    replays, rates = {}, {}
    for rows in REPLAY_ROWS:
        for label, job, passes in (("compare", compare, 3), ("raw", raw, 1), ("store", store, 1)):
            key = f"{label}_{rows}"
            replays[key] = timed(lambda: job(spark, rows))
            rates[f"{key}_events_per_second"] = round(rows * passes / replays[key])
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")),
                "cpus": int(CPUS),
                "replay": replays,
                "replay_rates": rates,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

"""Quote stream derived from the `events` table, with repeats and faults mixed in.

Event type is the symbol and event id the sequence.  Every 97th event is repeated,
every 211th is back-dated, and receive times are late or early at fixed strides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.schema import ORDER_SCHEMA, Policy

_MINUTE = 60 * 10**9
_HOUR = 60 * _MINUTE

MAX_AGE_NS = _HOUR
MAX_SKEW_NS = 10 * _MINUTE
QUARTER_HOUR = 15 * _MINUTE

POLICIES = [
    Policy("no debounce", passthrough=True),
    Policy("fixed", 30 * _MINUTE, 30 * _MINUTE, 1e9),
    Policy("dynamic", 30 * _MINUTE, 6 * _HOUR, 20.0),
]

LONG_COOLDOWN = Policy("long", 12 * _HOUR, 48 * _HOUR, 20.0)

# symbol, order id, registered arrival, side, entry, stop, take-profit, limit offset (bps)
ORDERS = [
    ("click", "o-click", 0, "long", 100.0, 4.0, 15.0, 5.0),
    ("error", "o-error", 0, "long", 100.0, 25.0, 20.0, 5.0),
    ("purchase", "o-purchase", 0, "short", 100.0, 20.0, 4.0, 5.0),
    ("view", "o-view", 0, "long", 100.0, 25.0, 100.0, 5.0),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes before faults: symbol, sequence, timestamp_ns, bid, ask."""
    eid = F.col("event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    price = F.lit(100.0) * (F.lit(1.0) + (F.col("value") - F.lit(50.0)) * F.lit(1e-5))
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        eid.alias("sequence"),
        (micros * 1000).alias("timestamp_ns"),
        (price - F.lit(0.005)).alias("bid"),
        (price + F.lit(0.005)).alias("ask"),
    )


def events_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faulty stream as it arrives."""
    seq = F.col("sequence")
    copies = F.when((seq > 0) & (seq % 97 == 0), F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0))
    )
    late = F.when((seq > 0) & (seq % 211 == 0), F.lit(6 * _HOUR)).otherwise(F.lit(0))
    delay = (
        F.when(seq % 101 == 0, F.lit(2 * _HOUR))
        .when(seq % 103 == 0, F.lit(-30 * _MINUTE))
        .otherwise(F.lit(10**9))
    )
    bid = F.when(seq % 503 == 0, F.lit(float("nan"))).otherwise(F.col("bid"))
    ask = F.when(seq % 499 == 0, F.col("ask") - F.lit(0.02)).otherwise(F.col("ask"))
    rows = clean_ticks(spark, sf_dir).select("*", F.explode(copies).alias("copy"))
    rows = rows.withColumns(
        {"timestamp_ns": F.col("timestamp_ns") - late, "bid": bid, "ask": ask}
    )
    return rows.select(
        (seq * 2 + F.col("copy")).alias("arrival"),
        "symbol",
        "sequence",
        "timestamp_ns",
        "bid",
        "ask",
        (F.col("timestamp_ns") + delay).alias("receive_ns"),
    )


def events_orders(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ORDERS, ORDER_SCHEMA)

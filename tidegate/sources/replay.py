"""Deterministic replay streams with a price switch and injected faults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the replay experiment.
BASE_TIMESTAMP_NS = 1_700_000_000_000_000_000
STEP_NS = 10_000
SYMBOL = "SIM-USD"
CALM_PRICE = 100.0
CRASH_PRICE = 98.2
CRASH_FRACTION = 0.55


def _noise(index: Column, seed: int) -> Column:
    """Uniform in [-1, 1) from a hash of the row number, the same on every run."""
    return F.pmod(F.xxhash64(index, F.lit(seed)), F.lit(2**21)) / F.lit(float(2**20)) - F.lit(1.0)


def _symbol(index: Column) -> Column:
    """The symbol as data: the optimizer drops a literal from partitioning keys."""
    return F.when(index >= 0, SYMBOL)


def replay_ticks(spark: SparkSession, count: int, seed: int = 20261011) -> DataFrame:
    """`count` quotes 10 µs apart; the price drops 180 bps at 55 % of the stream."""
    if count < 1:
        raise ValueError("count must be positive")
    crash_at = max(1, int(count * CRASH_FRACTION))
    i = F.col("id")
    regime = F.when(i >= crash_at, CRASH_PRICE).otherwise(CALM_PRICE)
    price = regime * (F.lit(1.0) + _noise(i, seed) * F.lit(0.000025))
    return spark.range(count).select(
        _symbol(i).alias("symbol"),
        i.alias("sequence"),
        (F.lit(BASE_TIMESTAMP_NS) + i * STEP_NS).alias("timestamp_ns"),
        (price - F.lit(0.005)).alias("bid"),
        (price + F.lit(0.005)).alias("ask"),
    )


def raw_replay(spark: SparkSession, count: int, seed: int = 20261011) -> DataFrame:
    """Quotes of the raw pipeline: no faults, the drop at half of the stream."""
    if count < 1:
        raise ValueError("count must be positive")
    i = F.col("id")
    base = F.when(i >= count // 2, CRASH_PRICE).otherwise(CALM_PRICE)
    price = base + _noise(i, seed) * F.lit(0.00001)
    return spark.range(count).select(
        i.alias("arrival"),
        _symbol(i).alias("symbol"),
        i.alias("sequence"),
        (i * STEP_NS).alias("timestamp_ns"),
        (price - F.lit(0.005)).alias("bid"),
        (price + F.lit(0.005)).alias("ask"),
    )


def inject_faults(
    ticks: DataFrame,
    index: str = "sequence",
    step_ns: int = STEP_NS,
    dup_every: int = 97,
    backdate_every: int = 211,
    delay_every: int = 997,
    on_time_ns: int = 1_000,
    delayed_ns: int = 10_000_000,
) -> DataFrame:
    """Repeat, back-date and delay quotes of a stream numbered 0, 1, 2, ... by `index`.

    The arrival number of every copy follows from the index alone, so no shuffle is
    needed to number the stream.
    """
    i = F.col(index)
    copies = F.when((i > 0) & (i % dup_every == 0), F.array(F.lit(0), F.lit(1)))
    earlier = F.when(i > 0, F.expr(f"({index} - 1) div {dup_every}")).otherwise(F.lit(0))
    late = F.when((i > 0) & (i % backdate_every == 0), F.lit(5 * step_ns)).otherwise(F.lit(0))
    rows = (
        ticks.withColumn("timestamp_ns", F.col("timestamp_ns") - late)
        .select("*", F.explode(F.coalesce(copies, F.array(F.lit(0)))).alias("copy"))
        .withColumn("arrival", i + earlier + F.col("copy"))
    )
    delay = F.when(F.col("arrival") % delay_every == 0, F.lit(delayed_ns)).otherwise(F.lit(on_time_ns))
    return rows.withColumn("receive_ns", F.col("timestamp_ns") + delay).drop("copy")

"""Feed a stored table through the streaming pipeline, a slice of arrivals at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidegate.schema import Policy
from tidegate.session import new_path
from tidegate.streaming.process import process_stream
from tidegate.streaming.sinks import write_stream

LEAST_SLICES = 3
SLICE_ROWS = 2_000_000  # quotes handed to one run, so the size of a trigger stays bounded


def _by_slice(
    df: DataFrame, place: str, low: int, width: int, slices: int
) -> Callable[[int], DataFrame]:
    """Rows of a slice of positions; stored by slice, so that no slice reads the others' rows.

    Rows in front of the first slice belong to it; those without a position, or behind the
    last slice, to none.
    """
    spark = df.sparkSession
    path = new_path(spark, "slices")
    number = F.greatest(F.expr(f"({place} - ({low}L)) div {width}L"), F.lit(0)).alias("_slice")
    rows = df.select("*", number).where((F.col("_slice") < slices) & F.col(place).isNotNull())
    rows.write.partitionBy("_slice").parquet(path)
    stored = spark.read.schema(rows.schema).parquet(path)
    return lambda i: stored.where(F.col("_slice") == i).select(*df.columns)


def replay_as_stream(
    ticks: DataFrame,
    orders: DataFrame,
    policy: Policy,
    max_age_ns: int,
    max_skew_ns: int,
    slices: int | None = None,
    sink: Callable[[DataFrame, str, str], StreamingQuery] = write_stream,
    start_state: DataFrame | None = None,
) -> str:
    """Stop and restart the query between slices, so its state comes from the checkpoint.

    Orders are handed over with the slice of arrivals they are registered in, those from
    before the first quote with the first.  Both tables are read once, to be stored by slice:
    a run costs some seconds whatever its size, so their number follows the quotes and not the
    arrival numbers.  Returns the folder that `sink` wrote.
    """
    spark = ticks.sparkSession
    ticks_in, orders_in, out, checkpoint = (
        new_path(spark, n) for n in ("stream-ticks", "stream-orders", "stream-out", "stream-state")
    )
    low, high, rows = ticks.agg(F.min("arrival"), F.max("arrival"), F.count("*")).first()
    slices = slices or max(LEAST_SLICES, -(-rows // SLICE_ROWS))
    width = (high - low) // slices + 1
    quotes_of = _by_slice(ticks, "arrival", low, width, slices)
    orders_of = _by_slice(orders, "registered_arrival", low, width, slices)
    for i in range(slices):
        quotes_of(i).write.mode("append").parquet(ticks_in)
        orders_of(i).write.mode("append").parquet(orders_in)
        results = process_stream(
            spark.readStream.schema(ticks.schema).parquet(ticks_in),
            spark.readStream.schema(orders.schema).parquet(orders_in),
            policy,
            max_age_ns,
            max_skew_ns,
            start_state,
        )
        sink(results, out, checkpoint).awaitTermination()
    return out

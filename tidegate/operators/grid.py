"""Price-gap grid: at which gaps can a stop-limit order still be filled?"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Limit offsets and price gaps of the grid, in basis points.
OFFSETS_BPS = [0.0, 5.0, 10.0]
GAPS_BPS = [0.0, 1.0, 2.0, 5.0, 7.5, 10.0, 25.0, 50.0]

PARTITION_CELLS = 1_000_000  # intended cells of one partition of a dealt grid


def gap_grid(
    entries: DataFrame,
    stop_bps: float = 25.0,
    offsets: list[float] = OFFSETS_BPS,
    gaps: list[float] = GAPS_BPS,
    keys: list[str] | None = None,
) -> DataFrame:
    """All offsets and gaps for every row of `entries` (needs `entry_price`).

    The grid is a pair of literal arrays, so each entry row grows by a fixed factor
    without a join.  With `keys` the entries are dealt by them before they grow, into as many
    partitions as the grid needs: what then groups cells by these keys shuffles no cell, and
    its memory does not follow the size of an input split.
    """
    if keys:
        entries = _dealt(entries, keys, len(offsets) * len(gaps))
    bps = F.lit(10_000.0)
    stop = F.col("entry_price") * F.lit(1.0 - stop_bps / 10_000.0)
    rows = (
        entries.withColumn("_stop", stop)
        .withColumn("offset_bps", F.explode(F.array(*map(F.lit, offsets))))
        .withColumn("gap_bps", F.explode(F.array(*map(F.lit, gaps))))
        .withColumn("limit_price", F.col("_stop") * (F.lit(1.0) - F.col("offset_bps") / bps))
        .withColumn("observed_price", F.col("_stop") * (F.lit(1.0) - F.col("gap_bps") / bps))
    )
    fillable = F.col("observed_price") >= F.col("limit_price")
    return rows.withColumn("marketable", fillable).drop("_stop")


def _dealt(entries: DataFrame, keys: list[str], cells: int) -> DataFrame:
    least = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return entries.repartition(max(least, math.ceil(entries.count() * cells / PARTITION_CELLS)), *keys)


def pivot_grid(grid: DataFrame, keys: list[str], gaps: list[float] = GAPS_BPS) -> DataFrame:
    """One row per (keys..., offset), one column per gap."""
    cells = grid.groupBy(*keys, "offset_bps").agg(
        *[
            F.bool_or(F.when(F.col("gap_bps") == g, F.col("marketable"))).alias(
                f"gap_{g:g}".replace(".", "_")
            )
            for g in gaps
        ]
    )
    return cells


def boundary_check(
    grid: DataFrame, keys: list[str], tolerance: float = 1e-10
) -> DataFrame:
    """Per cell: does the flag recompute, and does it return to true at a larger gap?"""
    expected = F.col("observed_price") >= F.col("limit_price") - F.lit(tolerance)
    smaller = (
        Window.partitionBy(*keys, "offset_bps")
        .orderBy("gap_bps")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    lost = F.coalesce(F.max(~F.col("_expected")).over(smaller), F.lit(False))
    rows = grid.withColumn("_expected", expected)
    return rows.select(
        *grid.columns,
        (F.col("marketable") == F.col("_expected")).alias("flag_ok"),
        (lost & F.col("_expected")).alias("returns_true"),
    )


def grid_coverage(grid: DataFrame, keys: list[str]) -> DataFrame:
    """Cells and different offsets and gaps; cells are counted before they leave their partition."""
    none, one = F.lit(0).cast("bigint"), lambda c: F.col(c).isNotNull().cast("bigint")
    offsets = grid.groupBy(*keys, "offset_bps").agg(F.count("*").alias("cells"))
    gaps = grid.select(*keys, "gap_bps").distinct()
    counts = offsets.select(*keys, "cells", one("offset_bps").alias("offsets"), none.alias("gaps")).unionAll(
        gaps.select(*keys, none, none, one("gap_bps"))
    )
    total = lambda c: F.coalesce(F.sum(c), none).alias(c)
    return counts.groupBy(*keys).agg(total("cells"), total("offsets"), total("gaps"))

"""Comparison of repeated runs and of two result sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.operators.percentiles import exact_median


def median_of_repeats(
    runs: DataFrame, keys: list[str], run: str, timings: list[str], fields: list[str]
) -> DataFrame:
    """Median of each timing column; other fields come from run n div 2 (runs from 0)."""
    counts = runs.groupBy(*keys).agg(F.count("*").alias("measured_repeats"))
    middle = (
        runs.select(*keys, run, *fields)
        .join(counts, keys)
        .where(F.col(run) == F.expr("measured_repeats div 2"))
        .drop(run)
    )
    # One selection for all timings, then back to one column each.
    long = runs.select(*keys, *[F.col(t).cast("double").alias(t) for t in timings])
    medians = exact_median(long.unpivot(keys, timings, "_timing", "_value"), [*keys, "_timing"], "_value")
    wide = medians.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_timing") == t, F.col("_value"))).alias(t) for t in timings]
    )
    return middle.join(wide, keys)


def repeat_invariance(runs: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """(keys..., counter, invariant): is the counter the same in every run?"""
    same = [
        (F.min(c).eqNullSafe(F.max(c)) & (F.count(c).isin(0) | (F.count(c) == F.count("*")))).alias(c)
        for c in counters
    ]
    return runs.groupBy(*keys).agg(*same).unpivot(keys, counters, "counter", "invariant")


def _long(df: DataFrame, keys: list[str], columns: list[str], value: str) -> DataFrame:
    text = df.select(*keys, *[F.col(c).cast("string").alias(c) for c in columns])
    return text.unpivot(keys, columns, "check", value)


def parity_check(
    left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]
) -> DataFrame:
    """(keys..., check, left_value, right_value, match) over both result sets.

    A row missing on one side does not match.
    """
    a = _long(left, keys, columns, "left_value").withColumn("_left", F.lit(True))
    b = _long(right, keys, columns, "right_value").withColumn("_right", F.lit(True))
    both = a.join(b, [*keys, "check"], "full_outer")
    match = (
        F.col("_left").isNotNull()
        & F.col("_right").isNotNull()
        & F.col("left_value").eqNullSafe(F.col("right_value"))
    )
    return both.withColumn("match", match).drop("_left", "_right")


def parity_summary(parity: DataFrame, by: list[str]) -> DataFrame:
    return parity.groupBy(*by).agg(
        F.count("*").alias("compared"),
        F.count_if(~F.col("match")).alias("mismatches"),
        F.every("match").alias("passed"),
    )


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows on one side only (with repeats), tagged by side; empty if the tables agree."""
    tally = fresh_name(left.columns, "_tally")
    signed = left.withColumn(tally, F.lit(1)).unionByName(right.withColumn(tally, F.lit(-1)))
    rest = signed.groupBy(*left.columns).agg(F.sum(tally).alias(tally)).where(F.col(tally) != 0)
    side = F.when(F.col(tally) > 0, "left").otherwise("right")
    repeats = F.explode(F.sequence(F.lit(1), F.abs(F.col(tally)))).alias("_nth")
    return rest.select(*left.columns, side.alias("side"), repeats).drop("_nth")


def fresh_name(taken: list[str], name: str) -> str:
    while name in taken:
        name = f"_{name}"
    return name


def positional_reconcile(
    left: DataFrame, right: DataFrame, position: str, columns: list[str]
) -> DataFrame:
    """Compare two ordered tables row by row on an explicit position column."""
    return parity_check(left, right, [position], columns)


def missing_names(present: DataFrame, name: str, required: list[str]) -> DataFrame:
    """Required names that do not occur."""
    spark = present.sparkSession
    wanted = spark.range(1).select(F.explode(F.array(*map(F.lit, required))).alias(name))
    return wanted.join(present.select(name).distinct(), name, "left_anti")

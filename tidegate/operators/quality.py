"""Validation of quotes and the per-symbol quality gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions import quotes as q
from tidegate.operators.scan import AUTO, Arranged, Layout, Running, arrange, running
from tidegate.schema import (
    DUPLICATE,
    FUTURE,
    MAX_FUTURE_SKEW_NS,
    MAX_QUOTE_AGE_NS,
    OUT_OF_ORDER,
    PASS,
    STALE,
    check_bounds,
)


def with_mid(ticks: DataFrame) -> DataFrame:
    return ticks.withColumn("mid", q.mid_price())


def validate_quotes(ticks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into valid quotes and a quarantine that names the first broken rule."""
    marked = ticks.withColumn("invalid_reason", q.invalid_reason())
    valid = marked.where(F.col("invalid_reason").isNull()).drop("invalid_reason")
    return valid, marked.where(F.col("invalid_reason").isNotNull())


def validate_policies(policies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split a table of rate limits (base_ns, max_ns, stress_bps) like `Policy` checks one."""
    stress = F.col("stress_bps")
    reason = (
        F.when(F.coalesce(F.col("base_ns") < 0, F.lit(True)), "negative_base")
        .when(F.coalesce(F.col("max_ns") < F.col("base_ns"), F.lit(True)), "max_below_base")
        .when(~q.is_finite(stress) | (stress <= 0), "bad_stress")
    )
    marked = policies.withColumn("invalid_reason", reason)
    valid = marked.where(F.col("invalid_reason").isNull()).drop("invalid_reason")
    return valid, marked.where(F.col("invalid_reason").isNotNull())


def invalid_counts(ticks: DataFrame) -> DataFrame:
    return (
        ticks.groupBy(F.coalesce(q.invalid_reason(), F.lit("valid")).alias("invalid_reason"))
        .agg(F.count("*").alias("quotes"))
    )


def lenient_valid() -> Column:
    """Rule of the raw pipeline: positive bid, uncrossed, finite mid."""
    bid, ask = F.col("bid"), F.col("ask")
    usable = q.is_finite(q.mid_price()) & (bid > 0) & (ask >= bid)
    return F.coalesce(usable, F.lit(False))


def drop_invalid_ticks(ticks: DataFrame) -> DataFrame:
    return ticks.where(lenient_valid())


def mark_duplicates(rows: DataFrame) -> DataFrame:
    """A quote repeats if its sequence is not above every earlier one of the symbol.

    Repeats never exceed that maximum, so the plain running maximum is the last
    sequence that advanced, also past quotes rejected later.
    """
    last = F.coalesce(F.col("_last_sequence"), F.lit(-1))
    return rows.withColumn("_duplicate", F.col("sequence") <= last)


def sequence_scan() -> dict[str, Running]:
    return {"_last_sequence": Running("max", F.col("sequence"))}


def mark_gate(rows: DataFrame, layout: Layout, max_age_ns: int, max_skew_ns: int) -> DataFrame:
    """Add `gate_reason` to rows that already carry `_last_sequence`.

    The last accepted timestamp equals the running maximum over fresh, non-duplicate
    quotes: one that fails the order test is below that maximum, so including it
    changes nothing.
    """
    stale, future = q.is_stale(max_age_ns), q.is_future(max_skew_ns)
    fresh = ~F.col("_duplicate") & ~stale & ~future
    rows = running(
        mark_duplicates(rows),
        layout,
        {"_last_timestamp": Running("max", F.when(fresh, F.col("timestamp_ns")))},
    )
    late = F.col("timestamp_ns") < F.coalesce(F.col("_last_timestamp"), F.lit(-1))
    reason = (
        F.when(F.col("_duplicate"), DUPLICATE)
        .when(late, OUT_OF_ORDER)
        .when(stale, STALE)
        .when(future, FUTURE)
        .otherwise(PASS)
    )
    return rows.withColumn("gate_reason", reason).drop(
        "_duplicate", "_last_sequence", "_last_timestamp"
    )


def quality_gate(
    ticks: DataFrame | Arranged,
    max_age_ns: int = MAX_QUOTE_AGE_NS,
    max_skew_ns: int = MAX_FUTURE_SKEW_NS,
    bits: int | str = AUTO,
) -> DataFrame:
    """Add `gate_reason` to valid quotes: duplicate, late, stale, future or pass."""
    return arranged_gate(ticks, max_age_ns, max_skew_ns, bits).df


def arranged_gate(
    ticks: DataFrame | Arranged,
    max_age_ns: int = MAX_QUOTE_AGE_NS,
    max_skew_ns: int = MAX_FUTURE_SKEW_NS,
    bits: int | str = AUTO,
) -> Arranged:
    """The same, for further scans over the table that the gate arranged."""
    check_bounds(max_age_ns, max_skew_ns)
    stream = arrange(ticks, bits)
    rows = running(stream.rows, stream.layout, sequence_scan())
    return Arranged(mark_gate(rows, stream.layout, max_age_ns, max_skew_ns), stream.layout)


def monotonic_guard(
    ticks: DataFrame | Arranged, on_error: str = "flag", bits: int | str = AUTO
) -> DataFrame:
    """Flag (or fail on) quotes older than an earlier quote of the symbol."""
    if on_error not in ("flag", "fail"):
        raise ValueError("on_error must be 'flag' or 'fail'")
    stream = arrange(ticks, bits)
    latest = {"_latest": Running("max", F.col("timestamp_ns"))}
    rows = Arranged(running(stream.rows, stream.layout, latest), stream.layout).df
    backwards = F.coalesce(F.col("timestamp_ns") < F.col("_latest"), F.lit(False))
    if on_error == "fail":
        message = F.concat(F.lit("timestamps must not go back for symbol "), F.col("symbol"))
        backwards = F.when(backwards, F.raise_error(message).cast("boolean")).otherwise(F.lit(False))
    return rows.withColumn("backwards", backwards).drop("_latest")

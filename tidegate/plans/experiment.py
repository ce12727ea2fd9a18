"""Composite jobs: policy comparison, raw pipeline, storage audit, quote latency."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.functions import orders as o
from tidegate.functions import quotes as q
from tidegate.operators.audit import audit_ticks
from tidegate.operators.debounce import passing
from tidegate.operators.metrics import EventWindow, event_rate, policy_metrics
from tidegate.operators.percentiles import lower_rank_percentiles
from tidegate.operators.process import evaluate, raw_signals
from tidegate.operators.quality import lenient_valid
from tidegate.operators.scan import AUTO
from tidegate.schema import (
    BACKWARDS,
    MAX_FUTURE_SKEW_NS,
    MAX_POLICIES,
    MAX_QUOTE_AGE_NS,
    ORDER_SCHEMA,
    REPLAY_POLICIES,
    STOP,
    Policy,
)
from tidegate.sources.replay import SYMBOL
from tidegate.sources.reports import one_row
from tidegate.sources.ticks import DEFAULT_BATCH, append_ticks, scan_ticks

# Rate limit of the raw pipeline.
RAW_POLICY = Policy("dynamic debounce", 100_000, 2_000_000, 5.0)


def replay_orders(spark) -> DataFrame:
    order = [(SYMBOL, "replay", 0, "long", 100.0, 25.0, 50.0, 5.0)]
    return spark.createDataFrame(order, ORDER_SCHEMA)


def compare_policies(
    ticks: DataFrame,
    orders: DataFrame | None,
    policies: list[Policy] = REPLAY_POLICIES,
    window: EventWindow | None = None,
    max_age_ns: int = MAX_QUOTE_AGE_NS,
    max_skew_ns: int = MAX_FUTURE_SKEW_NS,
    by: list[str] | None = None,
    probe_mid: float | None = None,
    bits: int | str = AUTO,
) -> DataFrame:
    """One report row per policy over the same stream.

    Policies are columns of a plan, MAX_POLICIES at a time; more of them take more passes.
    """
    if len({p.name for p in policies}) != len(policies):
        raise ValueError("policy names must be unique")
    keep = ["sequence", *(by or [])]
    reports = []
    for at in range(0, max(1, len(policies)), MAX_POLICIES):
        some = policies[at : at + MAX_POLICIES]
        rows = evaluate(ticks, orders, some, max_age_ns, max_skew_ns, bits, keep)
        reports.append(policy_metrics(rows, some, window, by, probe_mid))
    return reduce(DataFrame.unionByName, reports)


def raw_pipeline(
    ticks: DataFrame,
    orders: DataFrame | None,
    policy: Policy = RAW_POLICY,
    bits: int | str = AUTO,
    on_backwards: str = "flag",
) -> DataFrame:
    """Counts of the ungated pipeline; unusable quotes and such that go back in time are
    counted and skipped, or the latter end the job with `on_backwards="fail"`."""
    rows = raw_signals(ticks, orders, [policy], bits, ["bid", "ask"], on_backwards)
    event = F.col("risk_event")
    fillable = o.limit_reached(F.col("risk_side"), q.mid_price(), event["limit_price"])
    signals = rows.agg(
        F.count_if(F.col("_accepted_0")).alias("signals_accepted"),
        F.count_if(passing() & ~F.col("_accepted_0")).alias("signals_debounced"),
        F.count_if(F.col("gate_reason") == BACKWARDS).alias("backwards_ticks"),
        F.count_if(event["kind"] == STOP).alias("stop_triggers"),
        F.coalesce(F.bool_or((event["kind"] == STOP) & fillable), F.lit(False)).alias(
            "stop_limit_marketable_at_gap"
        ),
    )
    invalid = ticks.agg(
        F.count("*").alias("ticks"), F.count_if(~lenient_valid()).alias("invalid_ticks")
    )
    # Timings leave out the warm-up and sample the rest at a fixed stride.
    n = F.col("ticks")
    warmup = F.least(F.expr("ticks div 10"), F.lit(10_000))
    stride = F.greatest(F.expr("ticks div 20000"), F.lit(1))
    sampled = lambda upto: F.floor((upto + stride - 1) / stride).cast("bigint")
    invalid = invalid.withColumns(
        {
            "warmup_ticks": warmup,
            "measured_ticks": n - warmup,
            "latency_sample_count": sampled(n) - sampled(warmup),
        }
    )
    return one_row(invalid, signals)


def store_and_audit(
    ticks: DataFrame, path: str, batch_size: int = DEFAULT_BATCH
) -> DataFrame:
    """Append to a table, read it back and audit it; one row.

    Rows already in the table count against the sequence range, as they should.
    """
    written = append_ticks(ticks, path, batch_size)
    table = scan_ticks(ticks.sparkSession, path)
    report = audit_ticks(table, written)
    return report.select(
        F.lit(batch_size).cast("bigint").alias("batch_size"),
        F.lit(written).cast("bigint").alias("rows_written"),
        "*",
    )


def audit_with_rate(table: DataFrame, by: list[str]) -> DataFrame:
    """Audit of stored ticks per setting, with the rate of its quotes per second."""
    rate = event_rate(table, by).select(*by, "events_per_second")
    return audit_ticks(table, by=by).join(rate, by)


def quote_latency(
    ticks: DataFrame,
    by: list[str],
    stride: int = 1,
    warmup: int = 0,
    order: str = "arrival",
) -> DataFrame:
    """Exact percentiles of receive time minus quote time, in microseconds.

    Quotes before `warmup` are left out and every `stride`-th of the rest is taken; see
    `warmup_rows` and `sample_stride` for the values the reports use.
    """
    age = F.col("receive_ns") - F.col("timestamp_ns")
    place = F.col(order)
    rows = ticks.where((place >= warmup) & q.sample_every(place, stride)).select(*by, age.alias("_age"))
    wide = lower_rank_percentiles(rows, by, "_age", {"p50": 0.50, "p95": 0.95, "p99": 0.99})
    return wide.select(
        *by, *[(F.col(p) / F.lit(1000.0)).alias(f"{p}_us") for p in ("p50", "p95", "p99")]
    )

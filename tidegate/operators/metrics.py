"""Counters per policy, event windows, and reshapes of report tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions import orders as o
from tidegate.functions import quotes as q
from tidegate.operators.debounce import passing
from tidegate.schema import DUPLICATE, FUTURE, OUT_OF_ORDER, STALE, STOP, Policy

# Counter columns of a policy report and the reason each one counts.
FAULT_COLUMNS = {
    "duplicate_sequences": DUPLICATE,
    "out_of_order_timestamps": OUT_OF_ORDER,
    "stale_quotes": STALE,
    "future_quotes": FUTURE,
}


@dataclass(frozen=True)
class EventWindow:
    """A fixed range of sequences [start, start + ticks)."""

    start: int
    ticks: int

    @staticmethod
    def after_switch(base_ticks: int, fraction: float = 0.55, width: int = 200) -> "EventWindow":
        start = max(1, int(base_ticks * fraction))
        return EventWindow(start, min(width, max(0, base_ticks - start)))

    def holds(self, sequence: Column) -> Column:
        return (sequence >= F.lit(self.start)) & (sequence < F.lit(self.start + self.ticks))


def policy_metrics(
    rows: DataFrame,
    policies: list[Policy],
    window: EventWindow | None = None,
    by: list[str] | None = None,
    probe_mid: float | None = None,
) -> DataFrame:
    """One report row per policy (and group) from evaluated quotes.

    All policies are counted in one aggregation over the quotes; the quotes are not
    multiplied by the policies.
    """
    by = by or []
    reason, event = F.col("gate_reason"), F.col("risk_event")
    counts = [
        F.count("*").alias("input_events"),
        F.count_if(passing()).alias("_valid"),
        *[F.count_if(reason == r).alias(c) for c, r in FAULT_COLUMNS.items()],
        F.count_if(event["kind"] == STOP).alias("stop_triggers"),
        *[F.count_if(F.col(f"_accepted_{i}")).alias(f"_acc_{i}") for i in range(len(policies))],
    ]
    if window is not None:
        inside = window.holds(F.col("sequence"))
        counts.append(F.count_if(passing() & inside).alias("_win_valid"))
        counts += [
            F.count_if(F.col(f"_accepted_{i}") & inside).alias(f"_win_acc_{i}")
            for i in range(len(policies))
        ]
    if probe_mid is not None:
        fillable = o.limit_reached(F.col("risk_side"), F.lit(probe_mid), event["limit_price"])
        counts.append(
            F.coalesce(F.bool_or((event["kind"] == STOP) & fillable), F.lit(False)).alias("_fill")
        )
    totals = rows.groupBy(*by).agg(*counts)

    def report(i: int, policy: Policy) -> Column:
        accepted, held = F.col(f"_acc_{i}"), F.col("_valid") - F.col(f"_acc_{i}")
        fields = [
            F.lit(policy.name).alias("policy"),
            F.col("input_events"),
            accepted.alias("accepted_signals"),
            held.alias("debounced_signals"),
            q.signal_reduction_pct(accepted, held).alias("signal_reduction_pct"),
            *[F.col(c) for c in FAULT_COLUMNS],
            F.col("stop_triggers"),
        ]
        if window is not None:
            fields += [
                F.lit(window.start).cast("bigint").alias("post_crash_window_start_sequence"),
                F.lit(window.ticks).cast("bigint").alias("post_crash_window_ticks"),
                F.col("_win_valid").alias("post_crash_window_valid_quotes"),
                F.col(f"_win_acc_{i}").alias("post_crash_window_accepted_signals"),
                (F.col("_win_valid") - F.col(f"_win_acc_{i}")).alias(
                    "post_crash_window_debounced_signals"
                ),
            ]
        if probe_mid is not None:
            fields.append(F.col("_fill").alias("stop_limit_marketable_at_crash"))
        return F.struct(*fields)

    return totals.select(*by, F.inline(F.array(*[report(i, p) for i, p in enumerate(policies)])))


def marketable_stops(rows: DataFrame, by: list[str]) -> DataFrame:
    """Stop events of evaluated quotes, and how many could be filled at their own mid."""
    event = F.col("risk_event")
    stop = event["kind"] == STOP
    fillable = o.limit_reached(F.col("risk_side"), q.mid_price(), event["limit_price"])
    return rows.groupBy(*by).agg(
        F.count_if(stop).alias("stop_triggers"), F.count_if(stop & fillable).alias("marketable_stops")
    )


def reason_counts(results: DataFrame, by: list[str]) -> DataFrame:
    return results.groupBy(*by).agg(F.count("*").alias("quotes"))


def event_rate(ticks: DataFrame, by: list[str], time_ns: str = "timestamp_ns") -> DataFrame:
    """Events per second over the time span of each group."""
    rows = ticks.groupBy(*by).agg(
        F.count("*").alias("events"),
        F.min(time_ns).alias("first_ns"),
        F.max(time_ns).alias("last_ns"),
    )
    rate = q.rate_per_second(F.col("events"), F.col("first_ns"), F.col("last_ns"))
    return rows.withColumn("events_per_second", rate)


def unpivot_quantiles(report: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """Wide percentile columns to (keys..., quantile, value)."""
    wide = report.select(*keys, *[F.col(c).alias(name) for name, c in columns.items()])
    return wide.unpivot(keys, list(columns), "quantile", "value")


def fault_counts(report: DataFrame, keys: list[str]) -> DataFrame:
    """One row per fault kind; kinds that never occurred keep their zero."""
    return report.select(*keys, *FAULT_COLUMNS).unpivot(
        keys, list(FAULT_COLUMNS), "fault", "events"
    )


def best_setting(results: DataFrame, setting: str, p50: str, ordinal: str, by: list[str]) -> DataFrame:
    """Setting with the lowest p50; the first one listed wins a tie."""
    return results.groupBy(*by).agg(
        F.min_by(setting, F.struct(p50, ordinal)).alias("best_setting"), F.min(p50).alias(p50)
    )


def rate_share(rows: DataFrame, condition: Column, by: list[str], time_ns: str = "timestamp_ns") -> DataFrame:
    """Rate of all rows over the rate of those that meet a condition, in one pass."""
    some = F.when(condition, F.col(time_ns))
    spans = rows.groupBy(*by).agg(
        F.count("*").alias("_n"), F.min(time_ns).alias("_a"), F.max(time_ns).alias("_b"),
        F.count(some).alias("_some_n"), F.min(some).alias("_some_a"), F.max(some).alias("_some_b"),
    )
    rate = lambda p: q.rate_per_second(F.col(f"{p}n"), F.col(f"{p}a"), F.col(f"{p}b"))
    both = spans.select(*by, rate("_").alias("numerator_rate"), rate("_some_").alias("denominator_rate"))
    safe = F.when(F.col("denominator_rate") > 0, F.col("denominator_rate"))
    return both.withColumn("ratio", F.col("numerator_rate") / safe)


def throughput_ratio(
    rates: DataFrame, label: str, rate: str, numerator: str, denominator: str, by: list[str]
) -> DataFrame:
    """Rate of one implementation over another; null where the other has no rate."""
    pick = lambda name: F.max(F.when(F.col(label) == name, F.col(rate)))
    both = rates.groupBy(*by).agg(
        pick(numerator).alias("numerator_rate"), pick(denominator).alias("denominator_rate")
    )
    safe = F.when(F.col("denominator_rate") > 0, F.col("denominator_rate"))
    return both.withColumn("ratio", F.col("numerator_rate") / safe)

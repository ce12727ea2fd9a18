"""Column expressions over one quote."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegate.schema import Policy

_LONG_MAX = 2**63 - 1


def is_finite(x: Column) -> Column:
    """False for null, NaN and both infinities."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def mid_price(bid: Column | None = None, ask: Column | None = None) -> Column:
    bid = F.col("bid") if bid is None else bid
    ask = F.col("ask") if ask is None else ask
    return (bid + ask) / F.lit(2.0)


def invalid_reason() -> Column:
    """First broken rule of a quote, null where the quote is valid.

    Spark orders NaN above every number, so finiteness is tested before sign.
    """
    symbol, seq, ts = F.col("symbol"), F.col("sequence"), F.col("timestamp_ns")
    bid, ask = F.col("bid"), F.col("ask")
    return (
        F.when(symbol.isNull() | ~symbol.rlike(r"(?U)\S"), "blank_symbol")
        .when(seq.isNull() | ts.isNull(), "missing_value")
        .when((seq < 0) | (ts < 0), "negative_value")
        .when(~is_finite(bid) | ~is_finite(ask), "non_finite_price")
        .when((bid <= 0) | (ask <= 0), "non_positive_price")
        .when(bid > ask, "crossed_quote")
        .when(~is_finite(mid_price()), "non_finite_mid")
    )


def move_bps(mid: Column, previous: Column) -> Column:
    """Absolute move against the previous mid in basis points; null without one."""
    return F.abs(mid - previous) / previous * F.lit(10_000.0)


def cooldown_ns(policy: Policy, move: Column) -> Column:
    """Quiet period after a move; the base period where there was no move yet.

    `policy` may hold columns instead of numbers.
    Compared with the maximum before the cast: an overflowing cast raises.
    """
    base, longest = F.lit(policy.base_ns), F.lit(policy.max_ns)
    scaled = base.cast("double") * (F.lit(1.0) + move / F.lit(policy.stress_bps))
    return (
        F.when(move.isNull(), base)
        .when(scaled >= longest.cast("double"), longest)
        .otherwise(scaled.cast("bigint"))
        .cast("bigint")
    )


def stress_deadline(policy: Policy, ts: Column, mid: Column, previous: Column) -> Column:
    """Time until which a sharp move blocks signals; null where the move is calm."""
    move = move_bps(mid, previous)
    end = F.try_add(ts, cooldown_ns(policy, move))
    return F.when(move >= F.lit(policy.stress_bps), F.coalesce(end, F.lit(_LONG_MAX)))


def is_stale(max_age_ns: int) -> Column:
    age = F.col("receive_ns") - F.col("timestamp_ns")
    return F.coalesce(age > F.lit(max_age_ns), F.lit(False))


def is_future(max_skew_ns: int) -> Column:
    age = F.col("receive_ns") - F.col("timestamp_ns")
    return F.coalesce(age < F.lit(-max_skew_ns), F.lit(False))


def signal_reduction_pct(accepted: Column, debounced: Column) -> Column:
    total = accepted + debounced
    return F.when(total > 0, F.lit(100.0) * debounced / total).otherwise(F.lit(0.0))


def rate_per_second(count: Column, first_ns: Column, last_ns: Column) -> Column:
    span = last_ns - first_ns
    return F.when(span > 0, count / (span / F.lit(1e9))).otherwise(F.lit(0.0))


def within(actual: Column, expected: Column, tolerance: float) -> Column:
    return F.abs(actual - expected) <= F.lit(tolerance)


def meets_target(p50_us: Column, target_us: float = 10.0) -> Column:
    return p50_us < F.lit(target_us)


def sample_every(order: Column, stride: int) -> Column:
    if stride < 1:
        raise ValueError("stride must be positive")
    return order % F.lit(stride) == 0


def sample_stride(rows: int, samples: int = 20_000) -> int:
    return max(1, rows // samples)


def warmup_rows(rows: int, limit: int = 10_000) -> int:
    return min(rows // 10, limit)

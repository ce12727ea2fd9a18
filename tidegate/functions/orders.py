"""Column expressions over one stop / take-profit order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegate.functions.quotes import is_finite

_BPS = 10_000.0


def invalid_order_reason() -> Column:
    """First broken rule of an order, null where the order is valid."""
    entry, stop = F.col("entry_price"), F.col("stop_bps")
    target, offset = F.col("take_profit_bps"), F.col("limit_offset_bps")
    finite = is_finite(entry) & is_finite(stop) & is_finite(target) & is_finite(offset)
    known_side = F.coalesce(F.col("side").isin("long", "short"), F.lit(False))
    return (
        F.when(~finite, "non_finite_parameter")
        .when((entry <= 0) | (stop <= 0) | (target <= 0), "non_positive_parameter")
        .when((offset < 0) | (offset >= _BPS), "offset_out_of_range")
        .when(stop >= _BPS, "stop_out_of_range")
        .when(~known_side, "unknown_side")
    )


def price_levels() -> dict[str, Column]:
    """Stop, target and limit price; a short order mirrors a long one."""
    sign = F.when(F.col("side") == "long", F.lit(1.0)).otherwise(F.lit(-1.0))
    stop = F.col("entry_price") * (F.lit(1.0) - sign * F.col("stop_bps") / F.lit(_BPS))
    target = F.col("entry_price") * (F.lit(1.0) + sign * F.col("take_profit_bps") / F.lit(_BPS))
    limit = stop * (F.lit(1.0) - sign * F.col("limit_offset_bps") / F.lit(_BPS))
    return {"stop_price": stop, "target_price": target, "limit_price": limit}


def stop_hit(order: Column, mid: Column) -> Column:
    long = order["side"] == "long"
    return F.when(long, mid <= order["stop_price"]).otherwise(mid >= order["stop_price"])


def target_hit(order: Column, mid: Column) -> Column:
    long = order["side"] == "long"
    return F.when(long, mid >= order["target_price"]).otherwise(mid <= order["target_price"])


def limit_reached(side: Column, mid: Column, limit: Column) -> Column:
    return F.when(side == "long", mid >= limit).otherwise(mid <= limit)

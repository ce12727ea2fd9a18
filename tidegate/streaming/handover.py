"""From a batch run to a running query: the state that each symbol's stream goes on from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.functions import quotes as q
from tidegate.operators import spacing
from tidegate.operators.process import evaluate
from tidegate.operators.risk import oco_levels, validate_orders
from tidegate.operators.scan import AUTO, Running, arrange, running
from tidegate.schema import (
    DUPLICATE,
    FUTURE,
    MAX_FUTURE_SKEW_NS,
    MAX_QUOTE_AGE_NS,
    PASS,
    STALE,
    Policy,
)
from tidegate.session import cut
from tidegate.streaming.process import STATE_COLUMNS


def state_after(
    ticks: DataFrame,
    orders: DataFrame | None,
    policy: Policy,
    max_age_ns: int = MAX_QUOTE_AGE_NS,
    max_skew_ns: int = MAX_FUTURE_SKEW_NS,
    bits: int | str = AUTO,
) -> DataFrame:
    """One row per symbol with what the stream remembers of all rows given.

    The rows are run through the batch pipeline once; each part of the state is a maximum or
    a latest value of its outcomes, so it is combined before the shuffle and no symbol's rows
    meet in one task.  `orders` are those registered so far.  A symbol without valid quote or
    order has no row: it starts anew.
    """
    done = evaluate(ticks, orders, [policy], max_age_ns, max_skew_ns, bits, keep=["sequence", "bid", "ask"])
    stream = arrange(done, bits).withColumns({"mid": q.mid_price()})
    passes, ts = F.col("gate_reason") == PASS, F.col("timestamp_ns")
    previous = {"_previous": Running("last", F.when(passes, F.col("mid")))}
    rows = running(stream.rows, stream.layout, previous)
    untimely = F.col("gate_reason").isin(DUPLICATE, STALE, FUTURE)
    never = F.lit(None).cast("bigint") if policy.passthrough else F.when(
        passes, q.stress_deadline(policy, ts, F.col("mid"), F.col("_previous"))
    )
    signal = F.lit(None).cast("bigint") if policy.passthrough else F.when(F.col("_accepted_0"), ts)
    last_mid = F.max_by(F.when(passes, F.col("mid")), F.when(passes, F.col("arrival")))
    quotes = rows.groupBy("symbol").agg(
        F.max("sequence").alias("last_sequence"),
        F.max(F.when(~untimely, ts)).alias("last_timestamp"),
        (F.lit(None).cast("double") if policy.passthrough else last_mid).alias("last_mid"),
        F.max(never).alias("blocked_until"),
        F.max(signal).alias("last_signal"),
        F.max(F.when(F.col("risk_event").isNotNull(), F.col("arrival"))).alias("_event_at"),
    )
    if orders is None:
        kinds = dict(registered="bigint", side="string", stop_price="double", target_price="double",
                     limit_price="double", offset="double")
        known = quotes.withColumns({n: F.lit(None).cast(t) for n, t in kinds.items()})
    else:
        order = F.struct("side", "stop_price", "target_price", "limit_price", F.col("limit_offset_bps").alias("offset"))
        at = F.col("registered_arrival")
        levels = oco_levels(validate_orders(orders)[0])
        latest = levels.groupBy("symbol").agg(F.max(at).alias("registered"), F.max_by(order, at).alias("_order"))
        known = quotes.join(latest.select("symbol", "registered", "_order.*"), "symbol", "full")
    # An event at or behind the last registration is that of the order in force: one replaced
    # raises none.
    state = known.select(
        "symbol",
        F.coalesce("last_sequence", F.lit(-1)).alias("last_sequence"),
        F.coalesce("last_timestamp", F.lit(-1)).alias("last_timestamp"),
        "last_mid",
        F.coalesce("blocked_until", F.lit(0)).alias("blocked_until"),
        F.coalesce("last_signal", F.lit(spacing.NEVER)).alias("last_signal"),
        F.coalesce("registered", F.lit(0)).alias("registered"),
        "side",
        "stop_price",
        "target_price",
        "limit_price",
        "offset",
        F.coalesce(F.col("_event_at") >= F.col("registered"), F.lit(False)).alias("triggered"),
    )
    return cut(state.select("symbol", *STATE_COLUMNS))

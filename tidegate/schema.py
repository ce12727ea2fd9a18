"""Schemas, reason names and policy settings shared by all operators."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import types as T

# The five columns of a quote, in storage order.
TICK_COLUMNS = ["symbol", "sequence", "timestamp_ns", "bid", "ask"]

TICK_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("sequence", T.LongType()),
        T.StructField("timestamp_ns", T.LongType()),
        T.StructField("bid", T.DoubleType()),
        T.StructField("ask", T.DoubleType()),
    ]
)

# A quote as it reached the system: `arrival` is unique and defines the order,
# `receive_ns` is null where the receive time is unknown.
ARRIVAL_SCHEMA = T.StructType(
    TICK_SCHEMA.fields
    + [
        T.StructField("arrival", T.LongType()),
        T.StructField("receive_ns", T.LongType()),
    ]
)

ORDER_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("order_id", T.StringType()),
        T.StructField("registered_arrival", T.LongType()),
        T.StructField("side", T.StringType()),
        T.StructField("entry_price", T.DoubleType()),
        T.StructField("stop_bps", T.DoubleType()),
        T.StructField("take_profit_bps", T.DoubleType()),
        T.StructField("limit_offset_bps", T.DoubleType()),
    ]
)

MESSAGE_SCHEMA = T.StructType(
    [
        T.StructField("sequence", T.LongType()),
        T.StructField("sent_ns", T.LongType()),
        T.StructField("received_ns", T.LongType()),
        T.StructField("acked_ns", T.LongType()),
        T.StructField("payload", T.StringType()),
        T.StructField("reply", T.StringType()),
    ]
)

RISK_EVENT_TYPE = (
    "struct<kind:string,symbol:string,trigger_price:double,"
    "limit_price:double,offset_bps:double>"
)

# Outcome names of a processed quote.
PASS = "pass"
DUPLICATE = "duplicate_sequence"
OUT_OF_ORDER = "out_of_order_timestamp"
STALE = "stale_quote"
FUTURE = "future_quote"
ACCEPTED = "accepted"
DEBOUNCED = "debounced"

# Mark of a quote that goes back in time where no gate runs.
BACKWARDS = "backwards_timestamp"

# Kinds of risk event.
STOP = "stop_triggered"
TAKE_PROFIT = "take_profit_triggered"

# Default time bounds of the quality gate.
MAX_QUOTE_AGE_NS = 5_000_000
MAX_FUTURE_SKEW_NS = 1_000_000

MAX_POLICIES = 64


@dataclass(frozen=True)
class Policy:
    """Settings of one signal rate limit; `passthrough` accepts everything."""

    name: str
    base_ns: int = 100_000
    max_ns: int = 2_000_000
    stress_bps: float = 10.0
    passthrough: bool = False

    def __post_init__(self) -> None:
        if self.passthrough:
            return
        if self.base_ns < 0:
            raise ValueError(f"{self.name}: base cooldown must not be negative")
        if self.max_ns < self.base_ns:
            raise ValueError(f"{self.name}: max cooldown must not be below base")
        if not math.isfinite(self.stress_bps) or self.stress_bps <= 0:
            raise ValueError(f"{self.name}: stress bps must be finite and positive")


# The three policies compared by the replay experiment.
REPLAY_POLICIES = [
    Policy("no debounce", passthrough=True),
    Policy("fixed debounce", 100_000, 100_000, 1_000_000_000.0),
    Policy("dynamic debounce", 100_000, 2_000_000, 5.0),
]


def check_policies(policies: list[Policy]) -> list[Policy]:
    """Policies become columns of one plan, so their number is bounded."""
    names = [p.name for p in policies]
    if not policies or len(policies) > MAX_POLICIES:
        raise ValueError(f"between 1 and {MAX_POLICIES} policies expected")
    if len(set(names)) != len(names):
        raise ValueError("policy names must be unique")
    return policies


def check_bounds(max_age_ns: int, max_skew_ns: int) -> None:
    if max_age_ns < 0 or max_skew_ns < 0:
        raise ValueError("time bounds must not be negative")

"""The whole quote pipeline: gate, risk events and signal decision per quote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.functions import quotes as q
from tidegate.operators.debounce import decide, explode_policies
from tidegate.operators.quality import lenient_valid, mark_gate, sequence_scan, validate_quotes
from tidegate.operators.risk import mark_hits, order_scan, with_orders
from tidegate.operators.scan import AUTO, BUCKET, Layout, Running, axis, plan_layout, running
from tidegate.schema import (
    BACKWARDS,
    MAX_FUTURE_SKEW_NS,
    MAX_QUOTE_AGE_NS,
    PASS,
    RISK_EVENT_TYPE,
    Policy,
    check_bounds,
    check_policies,
)


def _with_receive(ticks: DataFrame) -> DataFrame:
    if "receive_ns" in ticks.columns:
        return ticks
    return ticks.withColumn("receive_ns", F.lit(None).cast("bigint"))


def _signals(
    rows: DataFrame,
    policies: list[Policy],
    layout: Layout,
    has_orders: bool,
    keep: list[str] | None,
) -> DataFrame:
    """Risk events and accepted flags for rows with `gate_reason` and `mid`."""
    if has_orders:
        rows = mark_hits(rows)
    else:
        none = F.lit(None)
        rows = rows.withColumns(
            {
                "_hit": none.cast("bigint"),
                "_event": none.cast(RISK_EVENT_TYPE),
                "_side": none.cast("string"),
            }
        )
    if keep is not None:
        needed = ["arrival", "timestamp_ns", "mid", "gate_reason", "_hit", "_event", "_side"]
        rows = rows.select(*dict.fromkeys([*layout.cells, *needed, *keep]))
    rows = decide(rows.drop("_rank"), policies, layout)
    event = F.when(F.col("_first_hit"), F.col("_event"))
    rows = rows.withColumn("risk_side", F.when(F.col("_first_hit"), F.col("_side")))
    return rows.withColumn("risk_event", event).drop("_first_hit", "_event", "_side")


def evaluate(
    ticks: DataFrame,
    orders: DataFrame | None,
    policies: list[Policy],
    max_age_ns: int = MAX_QUOTE_AGE_NS,
    max_skew_ns: int = MAX_FUTURE_SKEW_NS,
    bits: int | str = AUTO,
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per valid quote with `gate_reason`, `risk_event`, the side of the order it
    comes from (`risk_side`) and `_accepted_<i>`.

    All policies see the same gated quotes, so the stream is shuffled and gated once
    however many policies are compared.  `keep` names the quote columns the caller reads
    (all by default); the others stay out of the Python step.
    """
    check_policies(policies)
    check_bounds(max_age_ns, max_skew_ns)
    ticks = _with_receive(ticks)
    valid = validate_quotes(ticks)[0]
    has_orders = orders is not None
    layout = plan_layout(axis(ticks, orders), bits, ("arrival", "_rank") if has_orders else ("arrival",))
    rows = valid.withColumn("mid", q.mid_price())
    scans = sequence_scan()
    if has_orders:
        rows = with_orders(rows, orders)
        scans.update(order_scan())
    rows = running(layout.start(rows), layout, scans)
    if has_orders:
        rows = rows.where(F.col("_rank") == 1).drop("_registered")
    rows = mark_gate(rows, layout, max_age_ns, max_skew_ns)
    return _signals(rows, policies, layout, has_orders, keep)


def compare(
    ticks: DataFrame,
    orders: DataFrame | None,
    policies: list[Policy],
    max_age_ns: int = MAX_QUOTE_AGE_NS,
    max_skew_ns: int = MAX_FUTURE_SKEW_NS,
    bits: int | str = AUTO,
) -> DataFrame:
    """Per (valid quote, policy): `accepted_signal`, `reason`, `risk_event`."""
    rows = evaluate(ticks, orders, policies, max_age_ns, max_skew_ns, bits)
    return explode_policies(rows, policies).drop("gate_reason", "risk_side")


def process(
    ticks: DataFrame,
    orders: DataFrame | None = None,
    policy: Policy | None = None,
    max_age_ns: int = MAX_QUOTE_AGE_NS,
    max_skew_ns: int = MAX_FUTURE_SKEW_NS,
    bits: int | str = AUTO,
) -> DataFrame:
    """Outcome of every valid quote under one policy (the adaptive one by default)."""
    policy = policy or Policy("default")
    return compare(ticks, orders, [policy], max_age_ns, max_skew_ns, bits).drop("policy")


def raw_signals(
    ticks: DataFrame,
    orders: DataFrame | None,
    policies: list[Policy],
    bits: int | str = AUTO,
    keep: list[str] | None = None,
    on_backwards: str = "flag",
) -> DataFrame:
    """Signals without the gate: every usable quote counts as passing.

    A quote older than an earlier one of its symbol changes nothing and gives no signal;
    its `gate_reason` is BACKWARDS.  With `on_backwards="fail"` it ends the job.
    """
    check_policies(policies)
    if on_backwards not in ("flag", "fail"):
        raise ValueError("on_backwards must be 'flag' or 'fail'")
    has_orders = orders is not None
    layout = plan_layout(axis(ticks, orders), bits, ("arrival", "_rank") if has_orders else ("arrival",))
    rows = ticks.where(lenient_valid()).withColumn("mid", q.mid_price())
    scans = {"_latest": Running("max", F.col("timestamp_ns"))}
    if has_orders:
        rows = with_orders(rows, orders)
        scans.update(order_scan())
    rows = running(layout.start(rows), layout, scans)
    if has_orders:
        rows = rows.where(F.col("_rank") == 1).drop("_registered")
    late = F.coalesce(F.col("timestamp_ns") < F.col("_latest"), F.lit(False))
    if on_backwards == "fail":
        message = F.concat(F.lit("timestamps must not go back for symbol "), F.col("symbol"))
        mark = F.raise_error(message).cast("string")
    else:
        mark = F.lit(BACKWARDS)
    rows = rows.withColumn("gate_reason", F.when(late, mark).otherwise(PASS)).drop("_latest")
    return _signals(rows, policies, layout, has_orders, keep)

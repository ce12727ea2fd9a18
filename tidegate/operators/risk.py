"""One-shot stop / take-profit orders on the stream of passing quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions import orders as o
from tidegate.functions import quotes as q
from tidegate.operators.debounce import passing
from tidegate.operators.scan import AUTO, BUCKET, Layout, Running, axis, plan_layout, running
from tidegate.schema import RISK_EVENT_TYPE, STOP, TAKE_PROFIT

_ORDER_FIELDS = [
    "registered_arrival",
    "order_id",
    "side",
    "stop_price",
    "target_price",
    "limit_price",
    "limit_offset_bps",
]


def validate_orders(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    marked = orders.withColumn("invalid_reason", o.invalid_order_reason())
    valid = marked.where(F.col("invalid_reason").isNull()).drop("invalid_reason")
    return valid, marked.where(F.col("invalid_reason").isNotNull())


def oco_levels(orders: DataFrame) -> DataFrame:
    """Add stop, target and limit price."""
    return orders.withColumns(o.price_levels())


def order_marks(orders: DataFrame) -> DataFrame:
    """Registrations as rows of the quote stream: they sort before their arrival."""
    levels = oco_levels(validate_orders(orders)[0])
    return levels.select(
        "symbol",
        F.col("registered_arrival").alias("arrival"),
        F.lit(0).alias("_rank"),
        F.struct(*_ORDER_FIELDS).alias("_registered"),
    )


def with_orders(ticks: DataFrame, orders: DataFrame) -> DataFrame:
    """Mix registrations into the stream; quotes get rank 1."""
    quotes = ticks.withColumn("_rank", F.lit(1))
    return quotes.unionByName(order_marks(orders), allowMissingColumns=True)


def order_scan() -> dict[str, Running]:
    """The order in force: the latest registration replaces every earlier one."""
    return {"_order": Running("last", F.col("_registered"), inclusive=True)}


def hit() -> Column:
    order, mid = F.col("_order"), F.col("mid")
    touched = o.stop_hit(order, mid) | o.target_hit(order, mid)
    return F.coalesce(passing() & touched, F.lit(False))


def risk_event(order: Column, mid: Column) -> Column:
    """Event of a hit; the stop is tested first."""
    stop = F.struct(
        F.lit(STOP).alias("kind"),
        F.col("symbol").alias("symbol"),
        order["stop_price"].alias("trigger_price"),
        order["limit_price"].alias("limit_price"),
        order["limit_offset_bps"].alias("offset_bps"),
    )
    target = F.struct(
        F.lit(TAKE_PROFIT).alias("kind"),
        F.col("symbol").alias("symbol"),
        order["target_price"].alias("trigger_price"),
        F.lit(None).cast("double").alias("limit_price"),
        F.lit(0.0).alias("offset_bps"),
    )
    event = F.when(o.stop_hit(order, mid), stop).otherwise(target)
    return event.cast(RISK_EVENT_TYPE)


def mark_hits(rows: DataFrame) -> DataFrame:
    """Turn `_order` into `_hit`, the registration of the order the quote hits, the
    event this hit would raise and the order's side; null on the many quotes that hit nothing."""
    registered = F.col("_order.registered_arrival")
    event = risk_event(F.col("_order"), F.col("mid"))
    return rows.withColumns(
        {
            "_hit": F.when(hit(), registered),
            "_event": F.when(hit(), event),
            "_side": F.when(hit(), F.col("_order.side")),
        }
    ).drop("_order")


def orders_in_force(
    gated: DataFrame, orders: DataFrame, bits: int | str = AUTO
) -> DataFrame:
    """Add `_order`, the order in force at each quote (null where there is none)."""
    layout = plan_layout(axis(gated, orders), bits, ("arrival", "_rank"))
    rows = running(layout.start(with_orders(gated, orders)), layout, order_scan())
    return rows.where(F.col("_rank") == 1).drop("_rank", "_registered", BUCKET)


def oco_trigger(gated: DataFrame, orders: DataFrame, bits: int | str = AUTO) -> DataFrame:
    """First hit of every order that is hit while in force; one row per order."""
    rows = orders_in_force(gated, orders, bits).withColumn("mid", q.mid_price())
    first = F.min_by(
        F.struct(
            F.col("arrival").alias("trigger_arrival"),
            F.col("sequence").alias("trigger_sequence"),
            F.col("mid").alias("trigger_mid"),
            F.col("_order").alias("_order"),
        ),
        F.col("arrival"),
    )
    hits = (
        rows.where(hit())
        .groupBy(
            "symbol",
            F.col("_order.order_id").alias("order_id"),
            F.col("_order.registered_arrival").alias("registered_arrival"),
        )
        .agg(first.alias("first"))
    )
    event = risk_event(F.col("_order"), F.col("trigger_mid"))
    return (
        hits.select("symbol", "order_id", "registered_arrival", "first.*")
        .withColumn("event", event)
        .select(
            "symbol",
            "order_id",
            "registered_arrival",
            "trigger_arrival",
            "trigger_sequence",
            "trigger_mid",
            F.col("_order.side").alias("side"),
            F.col("event.kind").alias("kind"),
            F.col("event.trigger_price").alias("trigger_price"),
            F.col("event.limit_price").alias("limit_price"),
            F.col("event.offset_bps").alias("offset_bps"),
        )
    )


def limit_marketable(
    triggers: DataFrame, quotes: DataFrame, orders: DataFrame, bits: int | str = AUTO
) -> DataFrame:
    """Per quote: can the limit of the order in force be filled at this mid?

    True only after a stop trigger of an order not replaced since.  Registrations and
    triggers join the quote stream as rows, so each quote meets one state, never a pair
    per earlier trigger.
    """
    layout = plan_layout(axis(quotes, orders), bits, ("arrival", "_rank"))
    none = F.lit(None).cast("double")
    registered = orders.select(
        "symbol",
        F.col("registered_arrival").alias("arrival"),
        F.lit(0).alias("_rank"),
        F.struct(
            F.col("order_id"),
            F.col("side"),
            F.lit("").alias("kind"),
            none.alias("limit_price"),
        ).alias("_mark"),
    )
    triggered = triggers.select(
        "symbol",
        F.col("trigger_arrival").alias("arrival"),
        F.lit(1).alias("_rank"),
        F.struct("order_id", "side", "kind", "limit_price").alias("_mark"),
    )
    rows = (
        quotes.withColumn("mid", q.mid_price())
        .withColumn("_rank", F.lit(2))
        .unionByName(registered, allowMissingColumns=True)
        .unionByName(triggered, allowMissingColumns=True)
    )
    state = {"_state": Running("last", F.col("_mark"), inclusive=True)}
    rows = running(layout.start(rows), layout, state).where(F.col("_rank") == 2)
    reached = o.limit_reached(F.col("_state.side"), F.col("mid"), F.col("_state.limit_price"))
    fillable = (F.col("_state.kind") == STOP) & reached
    return rows.select(
        *quotes.columns,
        F.col("_state.order_id").alias("order_id"),
        F.coalesce(fillable, F.lit(False)).alias("marketable"),
    )

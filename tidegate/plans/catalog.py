"""Registered queries, each next to the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.functions import quotes as q
from tidegate.operators import audit, checks, compare, custom, debounce, grid, messages, metrics
from tidegate.operators import percentiles, policy_table, process, quality, risk, scan
from tidegate.plans import events_view as ev
from tidegate.plans import experiment, oracle
from tidegate.plans.events_view import MAX_AGE_NS, MAX_SKEW_NS, POLICIES
from tidegate.schema import TICK_COLUMNS, Policy
from tidegate.session import new_path
from tidegate.sources import frames, kvlog, replay, reports, ticks as tick_store
from tidegate.streaming import committed, sinks
from tidegate.streaming.demo import replay_as_stream
from tidegate.streaming.handover import state_after

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

FIXED, DYNAMIC = POLICIES[1], POLICIES[2]
SMALL_BUCKETS = 10  # bits; makes many buckets out of a small table
WINDOW_START, WINDOW_TICKS = 2_000, 1_500
_PERCENTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


def query(name: str, select: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if select is not None:
            ORACLES[name] = oracle.sql(select)
        return fn

    return register


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    return ev.events_ticks(spark, sf)


def valid(spark: SparkSession, sf: str) -> DataFrame:
    return quality.validate_quotes(ticks(spark, sf))[0]


def arranged(spark: SparkSession, sf: str, bits="auto") -> scan.Arranged:
    """The gated stream as one arranged table, for all scans of a query."""
    return quality.arranged_gate(valid(spark, sf), MAX_AGE_NS, MAX_SKEW_NS, bits)


def gated(spark: SparkSession, sf: str, bits="auto") -> DataFrame:
    return arranged(spark, sf, bits).df


# --- validation and gate ----------------------------------------------------------


@query("tick_mid", "SELECT arrival, symbol, mid FROM valid")
def tick_mid(spark, sf):
    return quality.with_mid(valid(spark, sf)).select("arrival", "symbol", "mid")


@query(
    "tick_validate",
    "SELECT arrival, symbol, sequence, invalid_reason FROM judged WHERE invalid_reason IS NOT NULL",
)
def tick_validate(spark, sf):
    quarantine = quality.validate_quotes(ticks(spark, sf))[1]
    return quarantine.select("arrival", "symbol", "sequence", "invalid_reason")


@query(
    "invalid_counts",
    """SELECT coalesce(invalid_reason, 'valid') AS invalid_reason, count(*) AS quotes
       FROM judged GROUP BY 1""",
)
def invalid_counts(spark, sf):
    return quality.invalid_counts(ticks(spark, sf))


@query("drop_invalid", "SELECT arrival, symbol, (bid + ask) / 2.0::DOUBLE AS mid FROM ticks "
       "WHERE bid > 0 AND ask >= bid AND isfinite((bid + ask) / 2.0::DOUBLE)")
def drop_invalid(spark, sf):
    kept = quality.drop_invalid_ticks(ticks(spark, sf))
    return kept.select("arrival", "symbol", q.mid_price().alias("mid"))


_GATE = "SELECT arrival, symbol, sequence, timestamp_ns, gate_reason FROM gated"
_GATE_COLUMNS = ["arrival", "symbol", "sequence", "timestamp_ns", "gate_reason"]


@query("gate_reasons", _GATE)
def gate_reasons(spark, sf):
    return gated(spark, sf).select(*_GATE_COLUMNS)


@query("gate_reasons_bucketed", _GATE)
def gate_reasons_bucketed(spark, sf):
    return gated(spark, sf, SMALL_BUCKETS).select(*_GATE_COLUMNS)


@query(
    "gate_counts_by_symbol",
    "SELECT symbol, gate_reason, count(*) AS quotes FROM gated GROUP BY ALL",
)
def gate_counts_by_symbol(spark, sf):
    return metrics.reason_counts(gated(spark, sf), ["symbol", "gate_reason"])


@query(
    "monotonic_guard",
    """SELECT arrival, symbol, coalesce(timestamp_ns < max(timestamp_ns) OVER (
              PARTITION BY symbol ORDER BY arrival
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS backwards FROM valid""",
)
def monotonic_guard(spark, sf):
    flagged = quality.monotonic_guard(valid(spark, sf), bits=SMALL_BUCKETS)
    return flagged.select("arrival", "symbol", "backwards")


# --- debounce ---------------------------------------------------------------------


@query("move_bps", "SELECT arrival, symbol, previous_mid, move_bps FROM moved")
def move_bps(spark, sf):
    rows = debounce.with_previous_mid(arranged(spark, sf, SMALL_BUCKETS)).where(debounce.passing())
    return rows.select("arrival", "symbol", "previous_mid", "move_bps")


@query("cooldown", "SELECT arrival, symbol, cooldown_ns FROM cooled WHERE policy = 'dynamic'")
def cooldown(spark, sf):
    rows = debounce.with_cooldown(arranged(spark, sf), DYNAMIC).where(debounce.passing())
    return rows.select("arrival", "symbol", "cooldown_ns")


@query("stress_block", "SELECT policy, arrival, symbol, blocked FROM blocking")
def stress_block(spark, sf):
    rows = debounce.stress_block(arranged(spark, sf, SMALL_BUCKETS), [FIXED, DYNAMIC])
    return rows.select("policy", "arrival", "symbol", "blocked")


def _debounced(spark, sf, policy: Policy, bits="auto") -> DataFrame:
    rows = debounce.debounce(arranged(spark, sf, bits), [policy])
    return rows.select("arrival", "symbol", "accepted_signal", "reason")


_DEBOUNCED = "SELECT arrival, symbol, accepted_signal, reason FROM outcomes WHERE policy = '{}'"


@query("debounce_fixed", _DEBOUNCED.format("fixed"))
def debounce_fixed(spark, sf):
    return _debounced(spark, sf, FIXED)


@query("debounce_dynamic", _DEBOUNCED.format("dynamic"))
def debounce_dynamic(spark, sf):
    return _debounced(spark, sf, DYNAMIC)


@query("debounce_dynamic_bucketed", _DEBOUNCED.format("dynamic"))
def debounce_dynamic_bucketed(spark, sf):
    return _debounced(spark, sf, DYNAMIC, SMALL_BUCKETS)


@query("debounce_passthrough", _DEBOUNCED.format("no debounce"))
def debounce_passthrough(spark, sf):
    return _debounced(spark, sf, POLICIES[0])


@query(
    "debounce_long_cooldown",
    """SELECT s.arrival, s.symbol, a.arrival IS NOT NULL AS accepted_signal,
              CASE WHEN a.arrival IS NOT NULL THEN 'accepted' ELSE 'debounced' END AS reason
       FROM hot_gated s LEFT JOIN hot_accepted a ON a.arrival = s.arrival""",
)
def debounce_long_cooldown(spark, sf):
    """One symbol with all quotes, and quiet periods that span many buckets.

    Buckets and calls are kept small here, so that signals are carried through many groups.
    """
    quotes = ev.clean_ticks(spark, sf).withColumns(
        {"arrival": F.col("sequence"), "symbol": F.lit("all"), "gate_reason": F.lit("pass")}
    )
    rows = debounce.debounce(quotes, [ev.LONG_COOLDOWN], bits=5, steps_per_call=64)
    return rows.select("arrival", "symbol", "accepted_signal", "reason")


_CUSTOM = """
    SELECT g.arrival, g.symbol, coalesce(m.move_bps >= 5.0, FALSE) AS accepted_signal,
           CASE WHEN g.gate_reason <> 'pass' THEN g.gate_reason
                WHEN m.move_bps >= 5.0 THEN 'accepted' ELSE 'debounced' END AS reason
    FROM gated g LEFT JOIN moved m ON g.arrival = m.arrival
"""


@query("custom_column_policy", _CUSTOM)
def custom_column_policy(spark, sf):
    rows = custom.debounce_by_column(arranged(spark, sf), lambda: F.col("move_bps") >= 5.0)
    return rows.select("arrival", "symbol", "accepted_signal", "reason")


class MoveOnly:
    """Accepts quotes that moved 5 bps against the one before."""

    def summarise(self, ts, mid):
        return [float(mid[-1])]

    def merge(self, first, second):
        return second

    def accept(self, ts, mid, before):
        previous = np.concatenate(([np.nan if before is None else before[0]], mid[:-1]))
        return np.abs(mid - previous) / previous * 10_000.0 >= 5.0


@query("custom_scan_policy", _CUSTOM)
def custom_scan_policy(spark, sf):
    rows = custom.debounce_by_scan(arranged(spark, sf, SMALL_BUCKETS), MoveOnly())
    return rows.select("arrival", "symbol", "accepted_signal", "reason")


# --- policy reports ---------------------------------------------------------------

_METRICS = """
    SELECT policy, count(*) AS input_events,
           count(*) FILTER (reason = 'accepted') AS accepted_signals,
           count(*) FILTER (reason = 'debounced') AS debounced_signals,
           CASE WHEN count(*) FILTER (gate_reason = 'pass') > 0
                THEN 100.0::DOUBLE * count(*) FILTER (reason = 'debounced')
                     / count(*) FILTER (gate_reason = 'pass') ELSE 0.0 END AS signal_reduction_pct,
           count(*) FILTER (reason = 'duplicate_sequence') AS duplicate_sequences,
           count(*) FILTER (reason = 'out_of_order_timestamp') AS out_of_order_timestamps,
           count(*) FILTER (reason = 'stale_quote') AS stale_quotes,
           count(*) FILTER (reason = 'future_quote') AS future_quotes,
           (SELECT count(*) FROM triggers WHERE kind = 'stop_triggered') AS stop_triggers
"""


def _report(spark, sf, bits="auto", **options) -> DataFrame:
    return experiment.compare_policies(
        ticks(spark, sf),
        ev.events_orders(spark),
        POLICIES,
        max_age_ns=MAX_AGE_NS,
        max_skew_ns=MAX_SKEW_NS,
        bits=bits,
        **options,
    )


@query("policy_metrics", _METRICS + "FROM outcomes GROUP BY policy")
def policy_metrics(spark, sf):
    return _report(spark, sf)


@query("policy_metrics_bucketed", _METRICS + "FROM outcomes GROUP BY policy")
def policy_metrics_bucketed(spark, sf):
    return _report(spark, sf, SMALL_BUCKETS)


# --- rate limits read from a table --------------------------------------------------

def customer_policies(spark, sf) -> DataFrame:
    """One rate limit per customer; one in fifty has no usable stress threshold."""
    key = F.col("c_custkey")
    base = (1 + key % 97).cast("bigint") * F.lit(ev.QUARTER_HOUR)
    return ev.table(spark, sf, "customer").select(
        F.concat(F.lit("customer "), key.cast("string")).alias("policy"),
        base.alias("base_ns"),
        (base * (1 + key % 5)).alias("max_ns"),
        F.when(key % 50 == 7, F.lit(float("nan"))).otherwise((2 + key % 60).cast("double")).alias("stress_bps"),
    )


@query(
    "policy_table_metrics",
    """SELECT s.policy, s.base_ns, s.max_ns, input_events, coalesce(a.n, 0)::BIGINT AS accepted_signals,
           (valid - coalesce(a.n, 0))::BIGINT AS debounced_signals,
           100.0::DOUBLE * (valid - coalesce(a.n, 0)) / valid AS signal_reduction_pct, stale_quotes
    FROM table_settings s CROSS JOIN (
        SELECT count(*) AS input_events, count(*) FILTER (gate_reason = 'pass') AS valid,
               count(*) FILTER (gate_reason = 'stale_quote') AS stale_quotes FROM gated)
    LEFT JOIN (SELECT policy, sum(n) AS n FROM table_folds GROUP BY policy) a USING (policy)""",
)
def policy_table_metrics(spark, sf):
    """Every customer's rate limit over the same stream, in one plan."""
    usable = quality.validate_policies(customer_policies(spark, sf))[0]
    rows = policy_table.table_metrics(arranged(spark, sf), usable)
    return rows.select(
        "policy", "base_ns", "max_ns", "input_events", "accepted_signals", "debounced_signals",
        "signal_reduction_pct", "stale_quotes",
    )


_IN_WINDOW = f"sequence >= {WINDOW_START} AND sequence < {WINDOW_START + WINDOW_TICKS}"


@query(
    "window_metrics",
    f"""SELECT policy, symbol, count(*) FILTER (gate_reason = 'pass' AND {_IN_WINDOW})
                   AS post_crash_window_valid_quotes,
               count(*) FILTER (accepted_signal AND {_IN_WINDOW})
                   AS post_crash_window_accepted_signals,
               count(*) FILTER (reason = 'debounced' AND {_IN_WINDOW})
                   AS post_crash_window_debounced_signals
        FROM outcomes GROUP BY policy, symbol""",
)
def window_metrics(spark, sf):
    window = metrics.EventWindow(WINDOW_START, WINDOW_TICKS)
    rows = _report(spark, sf, by=["symbol"], window=window)
    return rows.select(
        "policy",
        "symbol",
        "post_crash_window_valid_quotes",
        "post_crash_window_accepted_signals",
        "post_crash_window_debounced_signals",
    )


@query(
    "fault_counts_long",
    """UNPIVOT (SELECT count(*) FILTER (gate_reason = 'duplicate_sequence') AS duplicate_sequences,
                       count(*) FILTER (gate_reason = 'out_of_order_timestamp') AS out_of_order_timestamps,
                       count(*) FILTER (gate_reason = 'stale_quote') AS stale_quotes,
                       count(*) FILTER (gate_reason = 'future_quote') AS future_quotes,
                       symbol FROM gated GROUP BY symbol)
       ON duplicate_sequences, out_of_order_timestamps, stale_quotes, future_quotes
       INTO NAME fault VALUE events""",
)
def fault_counts_long(spark, sf):
    counts = gated(spark, sf).groupBy("symbol").agg(
        *[
            F.count_if(F.col("gate_reason") == reason).alias(column)
            for column, reason in metrics.FAULT_COLUMNS.items()
        ]
    )
    return metrics.fault_counts(counts, ["symbol"])


# --- orders -----------------------------------------------------------------------


def part_orders(spark, sf) -> DataFrame:
    """One order per part; every 50th has a stop, every 70th an offset out of range."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("double")
    return ev.table(spark, sf, "part").select(
        F.col("p_brand").alias("symbol"),
        key.cast("string").alias("order_id"),
        key.alias("registered_arrival"),
        F.when(key % 2 == 0, "long").otherwise("short").alias("side"),
        F.col("p_retailprice").alias("entry_price"),
        F.when(key % 50 == 0, 10_000.0).otherwise(F.lit(1.0) + size).alias("stop_bps"),
        (F.lit(2.0) + size).alias("take_profit_bps"),
        F.when(key % 70 == 0, -1.0).otherwise(size / F.lit(4.0)).alias("limit_offset_bps"),
    )


_PART_ORDERS = """
    (SELECT *, CASE WHEN limit_offset_bps < 0 OR limit_offset_bps >= 10000 THEN 'offset_out_of_range'
                    WHEN stop_bps >= 10000 THEN 'stop_out_of_range' END AS invalid_reason
     FROM (SELECT p_partkey::VARCHAR AS order_id,
                  CASE WHEN p_partkey % 2 = 0 THEN 'long' ELSE 'short' END AS side,
                  CASE WHEN p_partkey % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sgn,
                  p_retailprice AS entry_price,
                  CASE WHEN p_partkey % 50 = 0 THEN 10000.0::DOUBLE
                       ELSE 1.0::DOUBLE + p_size END AS stop_bps,
                  2.0::DOUBLE + p_size AS take_profit_bps,
                  CASE WHEN p_partkey % 70 = 0 THEN -1.0::DOUBLE
                       ELSE p_size / 4.0::DOUBLE END AS limit_offset_bps
           FROM part)) o
"""


@query(
    "oco_levels",
    f"SELECT order_id, side, {oracle.LEVELS} FROM {_PART_ORDERS} WHERE invalid_reason IS NULL",
)
def oco_levels(spark, sf):
    levels = risk.oco_levels(risk.validate_orders(part_orders(spark, sf))[0])
    return levels.select("order_id", "side", "stop_price", "target_price", "limit_price")


@query(
    "order_validate",
    f"SELECT order_id, invalid_reason FROM {_PART_ORDERS} WHERE invalid_reason IS NOT NULL",
)
def order_validate(spark, sf):
    return risk.validate_orders(part_orders(spark, sf))[1].select("order_id", "invalid_reason")


_TRIGGERS = """SELECT symbol, order_id, registered_arrival, trigger_arrival, trigger_sequence,
                      trigger_mid, side, kind, trigger_price, limit_price, offset_bps FROM triggers"""


@query("oco_trigger", _TRIGGERS)
def oco_trigger(spark, sf):
    return risk.oco_trigger(gated(spark, sf), ev.events_orders(spark))


def moving_orders(spark, sf) -> DataFrame:
    """Every quote of the clean stream registers an order that replaces the one before."""
    seq = F.col("sequence")
    return ev.clean_ticks(spark, sf).select(
        "symbol",
        F.concat(F.lit("e"), seq.cast("string")).alias("order_id"),
        (seq * 2 + 1).alias("registered_arrival"),
        F.when(seq % 2 == 0, "long").otherwise("short").alias("side"),
        q.mid_price().alias("entry_price"),
        (F.lit(1.0) + seq % 7).alias("stop_bps"),
        (F.lit(2.0) + seq % 5).alias("take_profit_bps"),
        (seq % 3).cast("double").alias("limit_offset_bps"),
    )


@query("oco_asof_orders", "SELECT arrival, symbol, order_id, stop_price, target_price FROM in_force")
def oco_asof_orders(spark, sf):
    rows = risk.orders_in_force(gated(spark, sf), moving_orders(spark, sf), SMALL_BUCKETS)
    return rows.select(
        "arrival",
        "symbol",
        F.col("_order.order_id").alias("order_id"),
        F.col("_order.stop_price").alias("stop_price"),
        F.col("_order.target_price").alias("target_price"),
    )


@query(
    "oco_replaced_triggers",
    """SELECT symbol, order_id, arrival AS trigger_arrival, mid AS trigger_mid, kind
       FROM moving_hits WHERE nth = 1""",
)
def oco_replaced_triggers(spark, sf):
    rows = risk.oco_trigger(gated(spark, sf), moving_orders(spark, sf), SMALL_BUCKETS)
    return rows.select("symbol", "order_id", "trigger_arrival", "trigger_mid", "kind")


@query(
    "limit_marketable",
    """SELECT g.arrival, g.symbol, o.order_id,
              coalesce(t.kind = 'stop_triggered' AND CASE WHEN t.side = 'long'
                       THEN g.mid >= t.limit_price ELSE g.mid <= t.limit_price END, FALSE) AS marketable
       FROM gated g
       LEFT JOIN levels o ON o.symbol = g.symbol
       LEFT JOIN triggers t ON t.symbol = g.symbol AND t.trigger_arrival <= g.arrival
       WHERE g.gate_reason = 'pass'""",
)
def limit_marketable(spark, sf):
    quotes, orders = gated(spark, sf), ev.events_orders(spark)
    triggers = risk.oco_trigger(quotes, orders)
    rows = risk.limit_marketable(triggers, quotes.where(debounce.passing()), orders)
    return rows.select("arrival", "symbol", "order_id", "marketable")


# --- the whole pipeline -----------------------------------------------------------

_PROCESS = """
    SELECT o.arrival, o.symbol, o.sequence, o.accepted_signal, o.reason, t.kind AS risk_kind,
           t.trigger_price, t.limit_price, t.offset_bps
    FROM outcomes o LEFT JOIN {triggers} t
    ON t.symbol = o.symbol AND t.trigger_arrival = o.arrival
    WHERE o.policy = 'dynamic'
"""
_REPLACED = """(
    SELECT symbol, arrival AS trigger_arrival, kind,
           CASE WHEN kind = 'stop_triggered' THEN stop_price ELSE target_price END AS trigger_price,
           CASE WHEN kind = 'stop_triggered' THEN limit_price END AS limit_price,
           CASE WHEN kind = 'stop_triggered' THEN limit_offset_bps ELSE 0.0 END AS offset_bps
    FROM moving_hits WHERE nth = 1)"""


def flat_results(rows: DataFrame, *more: str) -> DataFrame:
    event: Column = F.col("risk_event")
    return rows.select(
        "arrival",
        "symbol",
        "sequence",
        *more,
        "accepted_signal",
        "reason",
        event["kind"].alias("risk_kind"),
        event["trigger_price"].alias("trigger_price"),
        event["limit_price"].alias("limit_price"),
        event["offset_bps"].alias("offset_bps"),
    )


def _processed(spark, sf, orders, bits="auto") -> DataFrame:
    rows = process.process(ticks(spark, sf), orders, DYNAMIC, MAX_AGE_NS, MAX_SKEW_NS, bits)
    return flat_results(rows)


@query("process_results", _PROCESS.format(triggers="triggers"))
def process_results(spark, sf):
    return _processed(spark, sf, ev.events_orders(spark))


@query("process_results_bucketed", _PROCESS.format(triggers="triggers"))
def process_results_bucketed(spark, sf):
    return _processed(spark, sf, ev.events_orders(spark), SMALL_BUCKETS)


@query("process_replaced_orders", _PROCESS.format(triggers=_REPLACED))
def process_replaced_orders(spark, sf):
    return _processed(spark, sf, moving_orders(spark, sf), SMALL_BUCKETS)


_TIMES = "o.sequence, o.timestamp_ns, o.receive_ns,"
_STREAMED = _PROCESS.replace("o.sequence,", _TIMES)


def _streamed(spark, sf, orders) -> DataFrame:
    rows = spark.read.parquet(replay_as_stream(ticks(spark, sf), orders, DYNAMIC, MAX_AGE_NS, MAX_SKEW_NS))
    return flat_results(rows, "timestamp_ns", "receive_ns")


@query("stream_process", _STREAMED.format(triggers="triggers"))
def stream_process(spark, sf):
    return _streamed(spark, sf, ev.events_orders(spark))


@query("stream_orders_while_running", _STREAMED.format(triggers=_REPLACED))
def stream_orders_while_running(spark, sf):
    """Every quote registers an order while the query runs; each meets the one in force."""
    return _streamed(spark, sf, moving_orders(spark, sf))


@query("stream_from_batch_state", _STREAMED.format(triggers=_REPLACED))
def stream_from_batch_state(spark, sf):
    """The first half of the arrivals by a batch run, the rest by a stream that goes on from it."""
    quotes, orders, rules = ticks(spark, sf), moving_orders(spark, sf), (DYNAMIC, MAX_AGE_NS, MAX_SKEW_NS)
    low, high = quotes.agg(F.min("arrival"), F.max("arrival")).first()
    middle = (low + high) // 2
    early = quotes.where(F.col("arrival") < middle), orders.where(F.col("registered_arrival") < middle)
    late = quotes.where(F.col("arrival") >= middle), orders.where(F.col("registered_arrival") >= middle)
    done = process.process(*early, *rules)
    streamed = spark.read.parquet(replay_as_stream(*late, *rules, start_state=state_after(*early, *rules)))
    rows = done.select(*streamed.columns).unionAll(streamed)
    return flat_results(rows, "timestamp_ns", "receive_ns")


@query("live_counters", "SELECT symbol, reason, count(*) AS quotes FROM outcomes WHERE policy = 'dynamic' "
       "GROUP BY symbol, reason")
def live_counters(spark, sf):
    """Outcome counts kept per trigger by the running query, then added up."""
    path = replay_as_stream(
        ticks(spark, sf), ev.events_orders(spark), DYNAMIC, MAX_AGE_NS, MAX_SKEW_NS, sink=sinks.count_reasons
    )
    return sinks.reason_totals(spark, path)


@query("marketable_stops", """
    SELECT symbol, count(*) FILTER (kind = 'stop_triggered') AS stop_triggers,
           count(*) FILTER (kind = 'stop_triggered' AND CASE side WHEN 'long' THEN mid >= limit_price
                                                       ELSE mid <= limit_price END) AS marketable_stops
    FROM (SELECT symbol, NULL AS kind, NULL AS side, NULL AS mid, NULL AS limit_price FROM valid
          UNION ALL SELECT symbol, kind, side, mid, limit_price FROM moving_hits WHERE nth = 1)
    GROUP BY symbol""")
def marketable_stops(spark, sf):
    """Stops of orders on both sides, some with their limit at the stop itself."""
    rows = process.evaluate(
        ticks(spark, sf), moving_orders(spark, sf), [DYNAMIC], MAX_AGE_NS, MAX_SKEW_NS, SMALL_BUCKETS,
        ["bid", "ask", "symbol"],
    )
    return metrics.marketable_stops(rows, ["symbol"])



@query("csv_json_agree", """
    SELECT 'csv_agrees_with_json' AS "check", pos || '.' || c AS subject, TRUE AS passed
    FROM (SELECT unnest([0, 1, 2]) AS pos) CROSS JOIN
         (SELECT unnest(['policy', 'input_events', 'accepted_signals']) AS c)
    WHERE (SELECT count(*) FROM ticks) > 0""")
def csv_json_agree(spark, sf):
    """Policy report written as CSV and as nested JSON, read back and compared by row."""
    report = _report(spark, sf)
    nested = reports.nest(report, "policies", ["policy"])
    document = reports.summary_document({"kind": F.lit("policy report")}, {"policies": nested})
    json_path, csv_path = new_path(spark, "json"), new_path(spark, "csv")
    reports.write_report(document, json_path, "json")
    back = reports.inline_rows(
        reports.read_json_report(spark, json_path, document.schema)[0], "policies"
    )
    columns = ["position", "policy", "input_events", "accepted_signals"]
    reports.write_report(back, csv_path, "csv", columns)
    flat = reports.read_csv_report(spark, csv_path, back.select(columns).schema)
    return checks.same_report_check(flat, back, "position", columns[1:]).select(
        "check", "subject", "passed"
    )


_RAW = """SELECT ticks, invalid_ticks, least(ticks // 10, 10000) AS warmup_ticks,
                 ticks - least(ticks // 10, 10000) AS measured_ticks,
                 (SELECT count(*) FROM clean
                  WHERE sequence >= least(ticks // 10, 10000)
                    AND sequence % greatest(ticks // 20000, 1) = 0) AS latency_sample_count,
                 signals_accepted, usable - signals_accepted AS signals_debounced,
                 stop_triggers, stop_limit_marketable_at_gap
          FROM (SELECT (SELECT count(*) FROM clean) AS ticks,
                       (SELECT count(*) FROM raw_gated) AS usable,
                       (SELECT count(*) FROM clean) - (SELECT count(*) FROM raw_gated) AS invalid_ticks,
                       (SELECT count(*) FROM raw_chain WHERE policy = 'dynamic') AS signals_accepted,
                       (SELECT count(*) FROM raw_hits WHERE nth = 1 AND kind = 'stop_triggered')
                           AS stop_triggers,
                       coalesce((SELECT bool_or(CASE WHEN side = 'long' THEN mid >= limit_price
                                                     ELSE mid <= limit_price END)
                                 FROM raw_hits WHERE nth = 1 AND kind = 'stop_triggered'), FALSE)
                           AS stop_limit_marketable_at_gap)"""


@query("raw_pipeline", _RAW)
def raw_pipeline(spark, sf):
    stream = ev.clean_ticks(spark, sf).withColumn("arrival", F.col("sequence"))
    return experiment.raw_pipeline(stream, ev.events_orders(spark), DYNAMIC, SMALL_BUCKETS).drop("backwards_ticks")


@query("raw_pipeline_guarded", """
    SELECT count(*) AS ticks, (SELECT count(*) FROM ticks) - (SELECT count(*) FROM guard_gated) AS invalid_ticks,
           (SELECT count(*) FROM guard_gated WHERE gate_reason <> 'pass') AS backwards_ticks,
           (SELECT count(*) FROM guard_chain WHERE policy = 'dynamic') AS signals_accepted,
           (SELECT count(*) FROM guard_gated WHERE gate_reason = 'pass')
               - (SELECT count(*) FROM guard_chain WHERE policy = 'dynamic') AS signals_debounced,
           (SELECT count(*) FROM guard_hits WHERE nth = 1 AND kind = 'stop_triggered') AS stop_triggers
    FROM ticks""")
def raw_pipeline_guarded(spark, sf):
    """The ungated pipeline on the faulty stream, where some quotes go back in time."""
    found = experiment.raw_pipeline(ticks(spark, sf), ev.events_orders(spark), DYNAMIC, SMALL_BUCKETS)
    return found.select(
        "ticks", "invalid_ticks", "backwards_ticks", "signals_accepted", "signals_debounced", "stop_triggers"
    )


# --- grid -------------------------------------------------------------------------

_GRID = f"""
    (SELECT p_partkey, offset_bps, gap_bps, stop * (1.0::DOUBLE - offset_bps / 10000.0::DOUBLE) AS limit_price,
            stop * (1.0::DOUBLE - gap_bps / 10000.0::DOUBLE) AS observed_price
     FROM (SELECT p_partkey, p_retailprice * (1.0::DOUBLE - 25.0::DOUBLE / 10000.0::DOUBLE) AS stop FROM part)
     CROSS JOIN (SELECT unnest({grid.OFFSETS_BPS})::DOUBLE AS offset_bps)
     CROSS JOIN (SELECT unnest({grid.GAPS_BPS})::DOUBLE AS gap_bps)) c
"""


def part_grid(spark, sf) -> DataFrame:
    entries = ev.table(spark, sf, "part").select(
        "p_partkey", F.col("p_retailprice").alias("entry_price")
    )
    return grid.gap_grid(entries, keys=["p_partkey"]).drop("entry_price")


@query("gap_grid", f"SELECT *, observed_price >= limit_price AS marketable FROM {_GRID}")
def gap_grid(spark, sf):
    return part_grid(spark, sf)


@query(
    "gap_grid_pivot",
    "SELECT p_partkey, offset_bps, "
    + ", ".join(
        f"bool_or(observed_price >= limit_price) FILTER (gap_bps = {g}) AS "
        + f"gap_{g:g}".replace(".", "_")
        for g in grid.GAPS_BPS
    )
    + f" FROM {_GRID} GROUP BY ALL",
)
def gap_grid_pivot(spark, sf):
    return grid.pivot_grid(part_grid(spark, sf), ["p_partkey"])


@query(
    "gap_boundary_check",
    f"""SELECT p_partkey, offset_bps, gap_bps,
               (observed_price >= limit_price) = (observed_price >= limit_price - 1e-10) AS flag_ok,
               coalesce(bool_or(observed_price < limit_price - 1e-10) OVER (
                   PARTITION BY p_partkey, offset_bps ORDER BY gap_bps
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE)
                   AND observed_price >= limit_price - 1e-10 AS returns_true
        FROM {_GRID}""",
)
def gap_boundary_check(spark, sf):
    rows = grid.boundary_check(part_grid(spark, sf), ["p_partkey"])
    return rows.select("p_partkey", "offset_bps", "gap_bps", "flag_ok", "returns_true")


# --- percentiles, rates, audits ---------------------------------------------------


def _us(column: str) -> str:
    return ", ".join(
        f"{oracle.percentile(column, p)} / 1000.0::DOUBLE AS {n}_us" for n, p in _PERCENTILES.items()
    )


_AGE = "(SELECT *, receive_ns - timestamp_ns AS age FROM ticks) t"


@query("latency_percentiles", f"SELECT symbol, {_us('age')} FROM {_AGE} GROUP BY symbol")
def latency_percentiles(spark, sf):
    return experiment.quote_latency(ticks(spark, sf), ["symbol"])


@query("sampled_latency", f"SELECT {_us('age')} FROM {_AGE} WHERE arrival % 7 = 0")
def sampled_latency(spark, sf):
    return experiment.quote_latency(ticks(spark, sf), [], stride=7)


@query(
    "price_percentiles",
    "SELECT l_returnflag, "
    + ", ".join(
        f"{oracle.percentile('cents', p)} AS {n}" for n, p in _PERCENTILES.items()
    )
    + """ FROM (SELECT l_returnflag, round(l_extendedprice * 100)::BIGINT AS cents FROM lineitem)
          GROUP BY l_returnflag""",
)
def price_percentiles(spark, sf):
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    rows = ev.table(spark, sf, "lineitem").select("l_returnflag", cents.alias("cents"))
    return percentiles.lower_rank_percentiles(rows, ["l_returnflag"], "cents", _PERCENTILES)


@query(
    "event_rate",
    """SELECT symbol, count(*) AS events, min(timestamp_ns) AS first_ns, max(timestamp_ns) AS last_ns,
              CASE WHEN max(timestamp_ns) > min(timestamp_ns)
                   THEN count(*) / ((max(timestamp_ns) - min(timestamp_ns)) / 1e9)
                   ELSE 0.0 END AS events_per_second
       FROM ticks GROUP BY symbol""",
)
def event_rate(spark, sf):
    return metrics.event_rate(ticks(spark, sf), ["symbol"])


_AUDIT = """count(*) AS rows_read_back, count(DISTINCT sequence) AS distinct_sequences,
            min(sequence) AS first_sequence, max(sequence) AS last_sequence,
            count(*) FILTER (bid IS NULL OR ask IS NULL OR bid <= 0 OR ask <= 0 OR bid > ask)
                AS bad_quotes, count(*) AS rows_requested"""


@query("tick_audit", f"SELECT *, rows_read_back = distinct_sequences AND first_sequence = 0 AND "
       f"last_sequence = rows_requested - 1 AND bad_quotes = 0 AS complete FROM (SELECT {_AUDIT} FROM clean)")
def tick_audit(spark, sf):
    return audit.audit_ticks(ev.clean_ticks(spark, sf))


@query("tick_audit_by_symbol", f"SELECT *, rows_read_back = distinct_sequences AND first_sequence = 0 AND "
       f"last_sequence = rows_requested - 1 AND bad_quotes = 0 AS complete "
       f"FROM (SELECT symbol, {_AUDIT} FROM ticks GROUP BY symbol)")
def tick_audit_by_symbol(spark, sf):
    return audit.audit_ticks(ticks(spark, sf), by=["symbol"])


@query(
    "sequence_gaps",
    """SELECT symbol, before + 1 AS first_missing, sequence - 1 AS last_missing
       FROM (SELECT symbol, sequence, lag(sequence) OVER (PARTITION BY symbol ORDER BY sequence) AS before
             FROM (SELECT DISTINCT symbol, sequence FROM ticks)) WHERE sequence > before + 1""",
)
def sequence_gaps(spark, sf):
    """Every range of sequences that a symbol lacks between its first and its last."""
    return audit.sequence_gaps(ticks(spark, sf), ["symbol"], SMALL_BUCKETS)


@query("store_and_audit", f"SELECT 4096 AS batch_size, rows_read_back AS rows_written, *, "
       f"rows_read_back = distinct_sequences AND first_sequence = 0 AND "
       f"last_sequence = rows_requested - 1 AND bad_quotes = 0 AS complete FROM (SELECT {_AUDIT} FROM clean)")
def store_and_audit(spark, sf):
    path = new_path(spark, "ticks")
    return experiment.store_and_audit(ev.clean_ticks(spark, sf), path, batch_size=4096)


@query("audit_with_rate", f"""
    SELECT *, rows_read_back = distinct_sequences AND first_sequence = 0 AND
              last_sequence = rows_requested - 1 AND bad_quotes = 0 AS complete
    FROM (SELECT symbol, {_AUDIT}, CASE WHEN max(timestamp_ns) > min(timestamp_ns)
                 THEN count(*) / ((max(timestamp_ns) - min(timestamp_ns)) / 1e9) ELSE 0.0 END AS events_per_second
          FROM ticks GROUP BY symbol)""")
def audit_with_rate(spark, sf):
    """Audit and rate of stored ticks for each setting (here: symbol)."""
    path = new_path(spark, "ticks")
    tick_store.append_ticks(ticks(spark, sf), path)
    return experiment.audit_with_rate(tick_store.scan_ticks(spark, path), ["symbol"])


@query("append_stream_audit", f"SELECT *, rows_read_back = distinct_sequences AND first_sequence = 0 AND "
       f"last_sequence = rows_requested - 1 AND bad_quotes = 0 AS complete FROM (SELECT {_AUDIT} FROM clean)")
def append_stream_audit(spark, sf):
    """Ticks that arrive as frames in two loads, appended live, each exactly once."""
    source, path, state = (new_path(spark, n) for n in ("frames", "table", "state"))
    rows = ev.clean_ticks(spark, sf)
    for late in (False, True):
        frames.write_tick_frames(rows.where((F.col("sequence") % 3 == 0) == F.lit(late)), source, mode="append")
        live = frames.stream_tick_frames(spark, source, max_files=4)[0]
        sinks.append_stream(live, path, state).awaitTermination()
    return audit.audit_ticks(tick_store.scan_ticks(spark, path))


@query("append_replayed_audit", f"SELECT *, rows_read_back = distinct_sequences AND first_sequence = 0 AND "
       f"last_sequence = rows_requested - 1 AND bad_quotes = 0 AS complete FROM (SELECT {_AUDIT} FROM clean)")
def append_replayed_audit(spark, sf):
    """The same loads with a commit per trigger; a trigger is repeated, rows of one that never
    committed lie about, and small batches are compacted between the loads."""
    source, path, state = (new_path(spark, n) for n in ("frames", "table", "state"))
    rows = ev.clean_ticks(spark, sf)
    for late in (False, True):
        part = rows.where((F.col("sequence") % 3 == 0) == F.lit(late))
        frames.write_tick_frames(part, source, mode="append")
        live = frames.stream_tick_frames(spark, source, max_files=4)[0]
        committed.append_committed(live, path, state, writer="live").awaitTermination()
        last = committed.commits(spark, path).where("writer = 'live'").agg(F.max("batch")).first()[0]
        again = part.where("sequence % 5 = 0")
        for _ in range(2):  # the same batch twice: the second changes nothing
            committed.append_batch(again.where("false"), path, "replayed", int(last))
        committed._write_rows(again, path, "broken", int(last), 1_000_000)  # no record follows
        committed.compact(spark, path)
    return audit.audit_ticks(committed.scan_committed(spark, path))


@query("append_and_scan", "SELECT symbol, sequence, timestamp_ns, bid, ask FROM clean UNION ALL "
       "SELECT symbol, sequence + 1000000000, timestamp_ns, bid, ask FROM clean")
def append_and_scan(spark, sf):
    path = new_path(spark, "ticks")
    rows = ev.clean_ticks(spark, sf)
    tick_store.append_ticks(rows, path)
    tick_store.append_ticks(rows.withColumn("sequence", F.col("sequence") + 1_000_000_000), path)
    return tick_store.scan_ticks(spark, path)


# --- messages ---------------------------------------------------------------------


def event_messages(spark, sf) -> DataFrame:
    """Message log in 8 channels with wrong sequences, impossible times and bad replies."""
    eid = F.col("event_id")
    sent = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    index = F.floor(eid / 8).cast("bigint")
    return ev.table(spark, sf, "events").select(
        (eid % 8).alias("channel"),
        index.alias("arrival"),
        (index + F.when(eid % 307 == 0, 1).otherwise(0)).alias("sequence"),
        sent.alias("sent_ns"),
        (sent + F.when(eid % 401 == 0, -5).otherwise(F.lit(2000) + (eid * 7919) % 50000)).alias(
            "received_ns"
        ),
        (sent + 60000 + (eid * 104729) % 90000).alias("acked_ns"),
        F.col("props").alias("payload"),
        F.when(eid % 409 == 0, F.concat(F.upper("props"), F.lit("!")))
        .otherwise(F.col("props"))
        .alias("reply"),
    )


@query(
    "sequence_continuity",
    """SELECT channel, arrival, row_number() OVER w - 1 AS expected_sequence,
              sequence <> row_number() OVER w - 1 AS bad_sequence,
              NOT (sent_ns > 0 AND received_ns >= sent_ns) AS invalid_timestamp
       FROM messages WINDOW w AS (PARTITION BY channel ORDER BY arrival)""",
)
def sequence_continuity(spark, sf):
    rows = messages.sequence_continuity(event_messages(spark, sf), ["channel"], bits=6)
    return rows.select(
        "channel", "arrival", "expected_sequence", "bad_sequence", "invalid_timestamp"
    )


def _latency(name: str, column: str) -> str:
    ranks = ", ".join(
        f"{oracle.percentile(column, p)} / 1000.0::DOUBLE AS {n}_{name}_us"
        for n, p in _PERCENTILES.items()
    )
    return f"""{ranks}, sum({column})::BIGINT / count({column}) / 1000.0::DOUBLE AS mean_{name}_us,
               max({column}) / 1000.0::DOUBLE AS max_{name}_us"""


_WARMUP = 20


@query(
    "message_report",
    f"""SELECT channel, count(*) FILTER (measured) AS measured_messages,
               count(one_way) AS timed_sample_count, {_latency("one_way", "one_way")},
               {_latency("round_trip", "round_trip")},
               count(received) / ((max(received) - min(received)) / 1e9)
                   AS throughput_messages_per_second,
               count(*) FILTER (bad) AS bad_sequences, count(*) FILTER (impossible) AS invalid_timestamps,
               count(*) FILTER (payload IS DISTINCT FROM reply) AS bad_payloads,
               CASE WHEN count(*) FILTER (payload IS DISTINCT FROM reply) = 0
                         AND count(*) FILTER (bad) = 0 THEN 'passed' ELSE 'failed' END AS payload_check,
               {oracle.percentile("one_way", 0.5)} / 1000.0::DOUBLE < 10.0 AS sub_10_us_p50
        FROM (SELECT *, CASE WHEN measured AND NOT impossible THEN received_ns - sent_ns END AS one_way,
                     CASE WHEN measured AND NOT impossible THEN acked_ns - sent_ns END AS round_trip,
                     CASE WHEN measured AND NOT impossible THEN received_ns END AS received
              FROM (SELECT *, idx >= {_WARMUP} AS measured, sequence <> idx AS bad,
                           NOT (sent_ns > 0 AND received_ns >= sent_ns) AS impossible
                    FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY arrival) - 1 AS idx
                          FROM messages)))
        GROUP BY channel""",
)
def message_report(spark, sf):
    return messages.message_report(event_messages(spark, sf), ["channel"], _WARMUP)


_REPLIES = "(SELECT * FROM messages WHERE arrival % 11 <> 0 UNION ALL SELECT channel, arrival + 100000000 AS arrival, sequence, sent_ns, received_ns, acked_ns, payload, reply FROM messages WHERE arrival % 13 = 0)"


@query(
    "payload_check",
    f"""SELECT channel, arrival, (m.channel IS NOT NULL)::INT AS sent,
               (r.channel IS NOT NULL)::INT AS replies,
               CASE WHEN r.channel IS NULL THEN 'missing_reply'
                    WHEN m.channel IS NULL THEN 'unexpected_reply'
                    WHEN m.payload IS NOT DISTINCT FROM r.reply THEN 'ok' ELSE 'mismatch' END AS status
        FROM messages m FULL JOIN {_REPLIES} r USING (channel, arrival)""",
)
def payload_check(spark, sf):
    log = event_messages(spark, sf)
    stray = log.where(F.col("arrival") % 13 == 0).withColumn(
        "arrival", F.col("arrival") + 100_000_000
    )
    replies = log.where(F.col("arrival") % 11 != 0).unionByName(stray)
    return messages.payload_check(log, replies, ["channel", "arrival"])


# --- runs and result sets ---------------------------------------------------------


def customer_runs(spark, sf) -> DataFrame:
    """Four runs per customer segment and order priority, with timings and counters."""
    orders = ev.table(spark, sf, "orders")
    return orders.groupBy(
        F.col("o_orderpriority").alias("setting"), (F.col("o_orderkey") % 4).alias("run")
    ).agg(
        (F.max("o_totalprice") - F.min("o_totalprice")).alias("spread"),
        F.max("o_totalprice").alias("top"),
        F.count("*").alias("orders"),
        F.max(F.length("o_orderstatus")).alias("status_length"),
    )


_RUNS = """(SELECT o_orderpriority AS setting, o_orderkey % 4 AS run,
                   max(o_totalprice) - min(o_totalprice) AS spread, max(o_totalprice) AS top,
                   count(*) AS orders, max(length(o_orderstatus)) AS status_length
            FROM orders GROUP BY ALL) r"""


@query(
    "median_repeats",
    f"""SELECT setting, count(*) AS measured_repeats, median(spread) AS spread, median(top) AS top,
               max(orders) FILTER (run = n // 2) AS orders
        FROM (SELECT *, count(*) OVER (PARTITION BY setting) AS n FROM {_RUNS}) GROUP BY setting""",
)
def median_repeats(spark, sf):
    return compare.median_of_repeats(
        customer_runs(spark, sf), ["setting"], "run", ["spread", "top"], ["orders"]
    ).select("setting", "measured_repeats", "spread", "top", "orders")


@query(
    "repeat_invariance",
    f"""UNPIVOT (SELECT setting, min(orders) = max(orders) AS orders,
                        min(status_length) = max(status_length) AS status_length
                 FROM {_RUNS} GROUP BY setting)
        ON orders, status_length INTO NAME counter VALUE invariant""",
)
def repeat_invariance(spark, sf):
    return compare.repeat_invariance(
        customer_runs(spark, sf), ["setting"], ["orders", "status_length"]
    )


def _symbol_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("symbol").agg(
        F.count("*").alias("quotes"),
        F.min("sequence").alias("first_sequence"),
        F.countDistinct("sequence").alias("sequences"),
    )


_SYMBOL_COUNTS = """(UNPIVOT (SELECT symbol, count(*)::VARCHAR AS quotes,
                            min(sequence)::VARCHAR AS first_sequence,
                            count(DISTINCT sequence)::VARCHAR AS sequences FROM {} GROUP BY symbol)
                     ON quotes, first_sequence, sequences INTO NAME "check" VALUE v)"""
_PARITY = f"""SELECT a.symbol, a."check", a.v AS left_value, b.v AS right_value, a.v = b.v AS match
              FROM {_SYMBOL_COUNTS.format("ticks")} a
              JOIN {_SYMBOL_COUNTS.format("clean")} b ON a.symbol = b.symbol AND a."check" = b."check" """


def _parity(spark, sf) -> DataFrame:
    return compare.parity_check(
        _symbol_counts(ticks(spark, sf)),
        _symbol_counts(ev.clean_ticks(spark, sf)),
        ["symbol"],
        ["quotes", "first_sequence", "sequences"],
    )


@query("parity_check", _PARITY)
def parity_check(spark, sf):
    return _parity(spark, sf)


@query(
    "parity_summary",
    f"""SELECT symbol, count(*) AS compared, count(*) FILTER (NOT match) AS mismatches,
               bool_and(match) AS passed FROM ({_PARITY}) GROUP BY symbol""",
)
def parity_summary(spark, sf):
    return compare.parity_summary(_parity(spark, sf), ["symbol"])


@query(
    "same_rows",
    """SELECT symbol, sequence, 'left' AS side FROM (
           SELECT symbol, sequence FROM ticks EXCEPT ALL SELECT symbol, sequence FROM clean)
       UNION ALL
       SELECT symbol, sequence, 'right' AS side FROM (
           SELECT symbol, sequence FROM clean EXCEPT ALL SELECT symbol, sequence FROM ticks)""",
)
def same_rows(spark, sf):
    left = ticks(spark, sf).select("symbol", "sequence")
    return compare.same_rows(left, ev.clean_ticks(spark, sf).select("symbol", "sequence"))


@query(
    "missing_names",
    """SELECT name AS o_orderpriority FROM (VALUES ('1-URGENT'), ('9-NEVER'), ('5-LOW')) t(name)
       WHERE name NOT IN (SELECT o_orderpriority FROM orders)""",
)
def missing_names(spark, sf):
    return compare.missing_names(
        ev.table(spark, sf, "orders"), "o_orderpriority", ["1-URGENT", "9-NEVER", "5-LOW"]
    )


_SWEEP = f"""(SELECT segment, capacity, count(*) AS messages,
                    {oracle.percentile("cents", 0.5)} / 100.0::DOUBLE AS p50
             FROM (SELECT o_orderstatus AS segment, (16 * 4 ** (o_orderkey % 4))::BIGINT AS capacity,
                          round(o_totalprice * 100)::BIGINT AS cents FROM orders)
             GROUP BY ALL) s"""


def order_sweep(spark, sf) -> DataFrame:
    """Median price per status and a made-up queue capacity: 16, 64, 256 or 1024."""
    rows = ev.table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("segment"),
        F.element_at(
            F.array(*map(F.lit, (16, 64, 256, 1024))), (F.col("o_orderkey") % 4 + 1).cast("int")
        ).cast("bigint").alias("capacity"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
    )
    keys = ["segment", "capacity"]
    p50 = percentiles.lower_rank_percentiles(rows, keys, "cents", {"p50": 0.5})
    counts = rows.groupBy(*keys).agg(F.count("*").alias("messages"))
    return p50.join(counts, keys).withColumn("p50", F.col("p50") / F.lit(100.0))


@query(
    "best_setting",
    f"SELECT segment, arg_min(capacity, (p50, capacity)) AS best_setting, min(p50) AS p50 "
    f"FROM {_SWEEP} GROUP BY segment",
)
def best_setting(spark, sf):
    return metrics.best_setting(order_sweep(spark, sf), "capacity", "p50", "capacity", ["segment"])


@query(
    "throughput_ratio",
    """SELECT symbol, numerator_rate, denominator_rate, numerator_rate / denominator_rate AS ratio
       FROM (SELECT symbol, max(r) FILTER (side = 'all') AS numerator_rate,
                    max(r) FILTER (side = 'passed') AS denominator_rate
             FROM (SELECT symbol, 'all' AS side,
                          count(*) / ((max(timestamp_ns) - min(timestamp_ns)) / 1e9) AS r
                   FROM gated GROUP BY symbol
                   UNION ALL
                   SELECT symbol, 'passed' AS side,
                          count(*) / ((max(timestamp_ns) - min(timestamp_ns)) / 1e9) AS r
                   FROM gated WHERE gate_reason = 'pass' GROUP BY symbol) GROUP BY symbol)""",
)
def throughput_ratio(spark, sf):
    return metrics.rate_share(gated(spark, sf), debounce.passing(), ["symbol"])


@query(
    "unpivot_quantiles",
    f"""UNPIVOT (SELECT symbol, {_us('age')} FROM {_AGE} GROUP BY symbol)
        ON p50_us AS p50, p95_us AS p95, p99_us AS p99 INTO NAME quantile VALUE value""",
)
def unpivot_quantiles(spark, sf):
    wide = experiment.quote_latency(ticks(spark, sf), ["symbol"])
    columns = {"p50": "p50_us", "p95": "p95_us", "p99": "p99_us"}
    return metrics.unpivot_quantiles(wide, ["symbol"], columns)


# --- sources ----------------------------------------------------------------------


@query(
    "frame_roundtrip",
    """SELECT sequence AS arrival, symbol, sequence, timestamp_ns, bid, ask FROM clean""",
)
def frame_roundtrip(spark, sf):
    path = new_path(spark, "frames")
    frames.write_tick_frames(ev.clean_ticks(spark, sf), path)
    back = frames.read_tick_frames(spark, path)[0]
    return back.select(F.col("sequence").alias("arrival"), "*")


@query(
    "frame_quarantine",
    "SELECT sequence, sequence % 3 AS fault FROM clean WHERE sequence % 5 = 0",
)
def frame_quarantine(spark, sf):
    """Every fifth frame lacks a key, has one too many, or is no object."""
    seq = F.col("sequence")
    more = F.to_json(F.struct(*TICK_COLUMNS, F.lit(1).alias("venue")))
    less = F.to_json(F.struct(*TICK_COLUMNS[:-1]))
    good = F.to_json(F.struct(*TICK_COLUMNS))
    fault = F.when(seq % 3 == 0, more).when(seq % 3 == 1, less).otherwise(F.lit("[1, 2]"))
    rows = ev.clean_ticks(spark, sf).select(
        "sequence", F.when(seq % 5 == 0, fault).otherwise(good).alias("value")
    )
    bad = frames.parse_frames(rows.withColumnRenamed("sequence", "frame"))[1]
    return bad.select(F.col("frame").alias("sequence"), (F.col("frame") % 3).alias("fault"))


_KV_FIELDS = {"orderkey": "bigint", "price": "double", "final": "boolean", "priority": "string"}


def order_log(spark, sf) -> DataFrame:
    """Each order as a run of key=value lines, with a noise line and a repeated key."""
    rows = ev.table(spark, sf, "orders")
    key = F.col("o_orderkey")
    lines = F.array(
        F.lit("run started"),
        F.concat(F.lit("orderkey="), key.cast("string")),
        F.lit("price=0.5"),
        F.concat(F.lit("price="), F.col("o_totalprice").cast("string")),
        F.when(key % 9 != 0, F.concat(F.lit("final="), (F.col("o_orderstatus") == "F").cast("string"))),
        F.concat(F.lit("priority=a="), F.col("o_orderpriority")),
    )
    return rows.select(
        key.cast("string").alias("run"), F.posexplode(lines).alias("line", "value")
    ).where(F.col("value").isNotNull())


@query(
    "kv_log",
    """SELECT o_orderkey::VARCHAR AS run, o_orderkey AS orderkey, o_totalprice AS price,
              CASE WHEN o_orderkey % 9 <> 0 THEN o_orderstatus = 'F' END AS final,
              'a=' || o_orderpriority AS priority FROM orders""",
)
def kv_log(spark, sf):
    return kvlog.kv_report(order_log(spark, sf), _KV_FIELDS)


@query(
    "kv_kinds",
    """SELECT key, kind, count(*) AS lines FROM (
           SELECT 'orderkey' AS key, 'int' AS kind FROM orders
           UNION ALL SELECT 'price', 'float' FROM orders
           UNION ALL SELECT 'price', 'float' FROM orders
           UNION ALL SELECT 'final', 'bool' FROM orders WHERE o_orderkey % 9 <> 0
           UNION ALL SELECT 'priority', 'text' FROM orders) GROUP BY ALL""",
)
def kv_kinds(spark, sf):
    return kvlog.parse_kv(order_log(spark, sf)).groupBy("key", "kind").agg(
        F.count("*").alias("lines")
    )


@query(
    "kv_missing",
    """SELECT o_orderkey::VARCHAR AS run, 'final,seed' AS missing FROM orders WHERE o_orderkey % 9 = 0
       UNION ALL
       SELECT o_orderkey::VARCHAR AS run, 'seed' AS missing FROM orders WHERE o_orderkey % 9 <> 0""",
)
def kv_missing(spark, sf):
    rows = kvlog.missing_keys(order_log(spark, sf), ["orderkey", "final", "seed"])
    return rows.select("run", F.concat_ws(",", "missing").alias("missing"))


@query(
    "inject_faults",
    """SELECT symbol, sequence, sequence + CASE WHEN sequence > 0 THEN (sequence - 1) // 97 ELSE 0 END
                  + copy AS arrival,
              timestamp_ns - CASE WHEN sequence > 0 AND sequence % 211 = 0 THEN 50000 ELSE 0 END
                  AS timestamp_ns,
              timestamp_ns - CASE WHEN sequence > 0 AND sequence % 211 = 0 THEN 50000 ELSE 0 END
                  + CASE WHEN (sequence + CASE WHEN sequence > 0 THEN (sequence - 1) // 97 ELSE 0 END
                               + copy) % 997 = 0 THEN 10000000 ELSE 1000 END AS receive_ns
       FROM copied""",
)
def inject_faults(spark, sf):
    rows = replay.inject_faults(ev.clean_ticks(spark, sf))
    return rows.select("symbol", "sequence", "arrival", "timestamp_ns", "receive_ns")


@query("report_roundtrip", _METRICS + "FROM outcomes GROUP BY policy")
def report_roundtrip(spark, sf):
    """Policy report through a nested JSON document and back."""
    report = _report(spark, sf)
    document = reports.summary_document(
        {"kind": F.lit("policy report")}, {"policies": reports.nest(report, "policies", ["policy"])}
    )
    path = new_path(spark, "report")
    reports.write_report(document, path, "json")
    back = reports.read_json_report(spark, path, document.schema)[0]
    return reports.inline_rows(back, "policies").drop("position")


# --- report checks ----------------------------------------------------------------


def summary_rows(spark, sf) -> DataFrame:
    """Policy report with the scalars of its summary document."""
    window = metrics.EventWindow(WINDOW_START, WINDOW_TICKS)
    report = _report(spark, sf, window=window, probe_mid=98.2)
    return report.withColumns(
        {
            "base_tick_count": F.col("input_events"),
            "input_event_count": F.col("input_events"),
            "window_ticks": F.lit(WINDOW_TICKS).cast("bigint"),
        }
    )


@query(
    "report_checks",
    f"""SELECT 'events_accounted' AS "check", policy AS subject, TRUE AS passed FROM (SELECT DISTINCT policy FROM outcomes)
        UNION ALL SELECT 'input_matches_summary', policy, TRUE FROM (SELECT DISTINCT policy FROM outcomes)
        UNION ALL SELECT 'duplicates_expected', policy, FALSE FROM (SELECT DISTINCT policy FROM outcomes)
        UNION ALL SELECT 'reduction_recomputes', policy, TRUE FROM (SELECT DISTINCT policy FROM outcomes)
        UNION ALL SELECT 'one_stop_not_marketable', policy,
            (SELECT count(*) FROM triggers WHERE kind = 'stop_triggered') = 1
            AND NOT coalesce((SELECT bool_or(CASE WHEN side = 'long' THEN 98.2 >= limit_price ELSE 98.2 <= limit_price END)
                     FROM triggers WHERE kind = 'stop_triggered'), FALSE)
            FROM (SELECT DISTINCT policy FROM outcomes)
        UNION ALL SELECT 'window_size', policy, TRUE FROM (SELECT DISTINCT policy FROM outcomes)
        UNION ALL SELECT 'window_accounted', policy,
            count(*) FILTER (gate_reason = 'pass' AND {_IN_WINDOW}) <= {WINDOW_TICKS}
            FROM outcomes GROUP BY policy
        UNION ALL SELECT 'policy_names', 'report', TRUE
        UNION ALL SELECT 'window_acceptance_falls', 'report',
            (SELECT count(*) FILTER (policy = 'no debounce') > count(*) FILTER (policy = 'fixed')
                    AND count(*) FILTER (policy = 'fixed') > count(*) FILTER (policy = 'dynamic')
             FROM outcomes WHERE accepted_signal AND {_IN_WINDOW})""",
)
def report_checks(spark, sf):
    report = summary_rows(spark, sf)
    names = [p.name for p in POLICIES]
    found = (
        checks.policy_checks(report)
        .unionByName(checks.policy_set_check(report, names))
        .unionByName(checks.window_order_check(report, names))
    )
    return found.select("check", "subject", "passed")


@query(
    "grid_checks",
    """SELECT c AS "check", p_partkey::VARCHAR AS subject, TRUE AS passed FROM part
       CROSS JOIN (VALUES ('grid_size'), ('grid_flags_recompute'), ('grid_boundary_monotone')) t(c)""",
)
def grid_checks(spark, sf):
    found = checks.grid_checks(part_grid(spark, sf), ["p_partkey"])
    return found.select("check", "subject", "passed")


@query(
    "message_checks",
    f"""SELECT unnest(['samples_match', 'payload_passed', 'no_bad_sequences', 'no_invalid_timestamps',
                       'quantiles_ordered', 'rate_positive', 'target_flag_agrees']) AS "check",
               channel::VARCHAR AS subject,
               unnest([measured >= 1 AND timed = measured, bad = 0 AND replies = 0, bad = 0, impossible = 0,
                       least_one_way >= 0, last > first, TRUE]) AS passed
        FROM (SELECT channel, count(*) FILTER (idx >= {_WARMUP}) AS measured,
                     count(*) FILTER (idx >= {_WARMUP} AND ok) AS timed,
                     count(*) FILTER (sequence <> idx) AS bad, count(*) FILTER (NOT ok) AS impossible,
                     count(*) FILTER (payload IS DISTINCT FROM reply) AS replies,
                     min(received_ns - sent_ns) FILTER (idx >= {_WARMUP} AND ok) AS least_one_way,
                     min(received_ns) FILTER (idx >= {_WARMUP} AND ok) AS first,
                     max(received_ns) FILTER (idx >= {_WARMUP} AND ok) AS last
              FROM (SELECT *, sent_ns > 0 AND received_ns >= sent_ns AS ok,
                           row_number() OVER (PARTITION BY channel ORDER BY arrival) - 1 AS idx
                    FROM messages)
              GROUP BY channel)""",
)
def message_checks(spark, sf):
    found = checks.message_checks(message_report(spark, sf), F.col("channel"))
    return found.select("check", "subject", "passed")


@query(
    "pipeline_checks",
    f"""SELECT unnest(['measured_count', 'warmup_rule', 'has_samples', 'no_invalid', 'signals_cover_ticks'])
                   AS "check", 'raw' AS subject,
               unnest([measured_ticks = ticks - warmup_ticks, ticks >= 1, latency_sample_count >= 1,
                       invalid_ticks = 0, signals_accepted + signals_debounced = ticks]) AS passed
        FROM ({_RAW})""",
)
def pipeline_checks(spark, sf):
    report = raw_pipeline(spark, sf).withColumn("run", F.lit("raw"))
    return checks.pipeline_checks(report, "run").select("check", "subject", "passed")


@query(
    "ratio_check",
    """SELECT 'ratio_recomputes' AS "check", symbol AS subject, TRUE AS passed FROM ticks GROUP BY symbol""",
)
def ratio_check(spark, sf):
    found = checks.ratio_check(throughput_ratio(spark, sf), F.col("symbol"), "ratio")
    return found.select("check", "subject", "passed")


@query(
    "policy_validate",
    """SELECT o_orderkey::VARCHAR AS policy,
              CASE WHEN o_orderkey % 3 = 1 AND o_orderkey % 2 = 0 THEN 'max_below_base'
                   WHEN o_orderkey % 3 = 2 THEN 'bad_stress' END AS invalid_reason
       FROM orders WHERE (o_orderkey % 3 = 1 AND o_orderkey % 2 = 0) OR o_orderkey % 3 = 2""",
)
def policy_validate(spark, sf):
    """Rate limits read from a table: a third has no usable stress threshold."""
    key = F.col("o_orderkey")
    settings = ev.table(spark, sf, "orders").select(
        key.cast("string").alias("policy"),
        F.lit(10).cast("bigint").alias("base_ns"),
        F.when((key % 3 == 1) & (key % 2 == 0), 9).otherwise(20).cast("bigint").alias("max_ns"),
        F.when(key % 3 == 2, F.lit(float("nan"))).otherwise(F.lit(5.0)).alias("stress_bps"),
    )
    return quality.validate_policies(settings)[1].select("policy", "invalid_reason")


@query(
    "sweep_checks",
    f"""SELECT 'settings_covered' AS "check", segment AS subject, count(*) = 4 AS passed FROM {_SWEEP} GROUP BY segment
        UNION ALL SELECT 'counts_agree', segment, min(messages) = max(messages) FROM {_SWEEP} GROUP BY segment
        UNION ALL SELECT 'best_is_lowest_p50', segment, arg_min(capacity, (p50, capacity)) = 16 FROM {_SWEEP} GROUP BY segment
        UNION ALL SELECT 'capacity_power_of_two', capacity::VARCHAR, TRUE FROM {_SWEEP}""",
)
def sweep_checks(spark, sf):
    sweep = order_sweep(spark, sf)
    found = checks.sweep_checks(
        sweep, "capacity", [16, 64, 256, 1024], ["messages"], "p50", F.lit(16), ["segment"]
    )
    sizes = checks.capacity_check(sweep, "capacity")
    return found.unionByName(sizes).select("check", "subject", "passed")


@query(
    "storage_checks",
    f"""SELECT unnest(['minimum_rows', 'counts_equal', 'range_complete', 'no_bad_quotes']) AS "check",
               symbol AS subject,
               unnest([rows_requested >= 1, rows_read_back = distinct_sequences,
                       first_sequence = 0 AND last_sequence = rows_requested - 1, bad_quotes = 0]) AS passed
        FROM (SELECT symbol, {_AUDIT} FROM ticks GROUP BY symbol)""",
)
def storage_checks(spark, sf):
    report = audit.audit_ticks(ticks(spark, sf), by=["symbol"])
    report = report.withColumn("rows_written", F.col("rows_read_back"))
    return checks.storage_checks(report, F.col("symbol")).select("check", "subject", "passed")


@query(
    "parity_checks",
    f"""SELECT 'parity_keys' AS "check", symbol AS subject, TRUE AS passed FROM ({_PARITY}) GROUP BY symbol
        UNION ALL SELECT 'parity_matches', symbol, bool_and(match) FROM ({_PARITY}) GROUP BY symbol""",
)
def parity_checks(spark, sf):
    required = ["quotes", "first_sequence", "sequences"]
    found = checks.parity_checks(_parity(spark, sf), required, ["symbol"])
    return found.select("check", "subject", "passed")


@query(
    "finite_checks",
    """SELECT 'finite_bid' AS "check", arrival::VARCHAR AS subject, isfinite(bid) AS passed FROM ticks
       UNION ALL SELECT 'finite_ask', arrival::VARCHAR, isfinite(ask) FROM ticks""",
)
def finite_checks(spark, sf):
    found = checks.finite_checks(ticks(spark, sf), F.col("arrival"), ["bid", "ask"])
    return found.select("check", "subject", "passed")


@query(
    "timing_checks",
    """SELECT 'rate_positive' AS "check", symbol AS subject, TRUE AS passed FROM ticks GROUP BY symbol
       UNION ALL SELECT 'quantiles_ordered', symbol, min(receive_ns - timestamp_ns) >= 0 OR
              list_sort(list(receive_ns - timestamp_ns))[(trunc((count(*) - 1) * 0.5::DOUBLE))::BIGINT + 1] >= 0
              FROM ticks GROUP BY symbol""",
)
def timing_checks(spark, sf):
    rows = ticks(spark, sf)
    report = experiment.quote_latency(rows, ["symbol"]).join(
        metrics.event_rate(rows, ["symbol"]), "symbol"
    )
    found = checks.timing_checks(report, "symbol", "events_per_second", ["p50_us", "p95_us", "p99_us"])
    return found.select("check", "subject", "passed")

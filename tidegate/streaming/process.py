"""The quote pipeline as a stateful streaming query, one small typed state per symbol.

Quotes are rejected with a reason, never dropped for being late, so no watermark is set.
Within one trigger the quotes of a symbol are put in arrival order; across triggers the
source must deliver them in order (a log offset, or files that appear in order).  A trigger
that brings more of a symbol than one Arrow batch is put in order through the state store:
batches are parked there by bucket of arrivals and taken back one bucket at a time, so what a
worker holds does not grow with the rows of a symbol in a trigger.  The state may start from
a batch run (`streaming/handover.py`) and may be forgotten for idle symbols.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import (
    StatefulProcessor,
    StatefulProcessorHandle,
    TimerValues,
)

from tidegate.operators import spacing
from tidegate.operators.quality import validate_quotes
from tidegate.operators.risk import oco_levels, validate_orders
from tidegate.schema import (
    ACCEPTED,
    DEBOUNCED,
    DUPLICATE,
    FUTURE,
    MAX_FUTURE_SKEW_NS,
    MAX_QUOTE_AGE_NS,
    OUT_OF_ORDER,
    STALE,
    STOP,
    TAKE_PROFIT,
    Policy,
    check_bounds,
)
from tidegate.session import keep_state_on_disk

_QUOTE = ["arrival", "sequence", "timestamp_ns", "bid", "ask", "receive_ns"]
# A whole number that may be null reaches pandas as a float and loses digits, so none may
# be: what a row has no value for is 0, and `received` tells whether a receive time is one.
_NUMBERS = ["sequence", "timestamp_ns", "receive_ns", "registered"]
_ORDER = ["registered", "side", "stop_price", "target_price", "limit_price", "offset"]

_STATE = (
    "last_sequence long, last_timestamp long, last_mid double, blocked_until long, "
    "last_signal long, registered long, side string, stop_price double, target_price double, "
    "limit_price double, offset double, triggered boolean"
)
_START = (-1, -1, None, 0, spacing.NEVER, None, None, None, None, None, None, False)
STATE_COLUMNS = [part.split()[0] for part in _STATE.split(", ")]

_OUTPUT = (
    "symbol string, arrival long, sequence long, timestamp_ns long, bid double, ask double, "
    "receive_ns long, received boolean, accepted_signal boolean, reason string, kind string, "
    "trigger_price double, limit_price double, offset_bps double"
)
_OUTPUT_COLUMNS = [part.split()[0] for part in _OUTPUT.split(", ")]

# Arrival numbers to a bucket of parked rows.  They are unique, and so are an order's, so a
# bucket holds no more than twice as many rows.
PARKED_BITS = 14


def _before(values: np.ndarray, start: int) -> np.ndarray:
    """Running maximum over earlier rows."""
    return np.maximum.accumulate(np.concatenate(([start], values)))[:-1]


def _gate(quotes: pd.DataFrame, state: dict, max_age: int, max_skew: int) -> np.ndarray:
    """Reason of each quote, '' where it passes; advances the gate's state."""
    seq, ts = quotes["sequence"].to_numpy(), quotes["timestamp_ns"].to_numpy()
    known = quotes["received"].to_numpy()
    age = np.where(known, quotes["receive_ns"].to_numpy() - ts, 0)
    duplicate = seq <= _before(seq, state["last_sequence"])
    stale, future = known & (age > max_age), known & (age < -max_skew)
    fresh = np.where(duplicate | stale | future, -1, ts)
    late = ts < _before(fresh, state["last_timestamp"])
    state["last_sequence"] = max(state["last_sequence"], int(seq.max()))
    state["last_timestamp"] = max(state["last_timestamp"], int(fresh.max()))
    return np.select([duplicate, late, stale, future], [DUPLICATE, OUT_OF_ORDER, STALE, FUTURE], "")


def _signals(ts: np.ndarray, mid: np.ndarray, state: dict, policy: Policy) -> np.ndarray:
    """Accepted flag of each passing quote; advances the rate limit's state."""
    flags = np.ones(len(ts), dtype=bool)
    if policy.passthrough or not len(ts):
        return flags
    ends = spacing.block_ends(
        ts, mid, policy.base_ns, policy.max_ns, policy.stress_bps, state["last_mid"]
    )
    ends = np.maximum(ends, state["blocked_until"])
    open_ = np.flatnonzero(ts >= ends)
    entry = spacing.entry_threshold(state["last_signal"], policy.base_ns, 0)
    chain = open_[spacing.accepted_rows(ts[open_], policy.base_ns, entry)]
    flags[:] = False
    flags[chain] = True
    state["last_mid"], state["blocked_until"] = float(mid[-1]), int(ends[-1])
    if len(chain):
        state["last_signal"] = int(ts[chain[-1]])
    return flags


def _risk_events(mid: np.ndarray, state: dict) -> tuple[int, tuple] | None:
    """First hit of the order in force, if it has not been hit before."""
    if state["registered"] is None or state["triggered"] or not len(mid):
        return None
    up = mid >= state["stop_price"], mid <= state["target_price"]
    down = mid <= state["stop_price"], mid >= state["target_price"]
    stop, target = down if state["side"] == "long" else up
    hits = np.flatnonzero(stop | target)
    if not len(hits):
        return None
    state["triggered"] = True
    at = int(hits[0])
    if stop[at]:
        return at, (STOP, state["stop_price"], state["limit_price"], state["offset"])
    return at, (TAKE_PROFIT, state["target_price"], None, 0.0)


def _advance(
    symbol: str, frame: pd.DataFrame, state: dict, policy: Policy, max_age: int, max_skew: int
) -> pd.DataFrame:
    """Outcomes of one symbol's next rows, given in any order; advances its state."""
    frame = frame.sort_values(["arrival", "rank"], kind="stable")
    is_order = (frame["rank"] == 0).to_numpy()
    quotes = frame[~is_order].reset_index(drop=True)
    out = quotes[[*_QUOTE, "received"]].assign(symbol=symbol, accepted_signal=False, reason="", kind=None)
    out[["trigger_price", "limit_price", "offset_bps"]] = np.nan
    events = out[["kind", "trigger_price", "limit_price", "offset_bps"]].astype(object)
    reasons = _gate(quotes, state, max_age, max_skew) if len(quotes) else np.array([], str)
    passed = np.flatnonzero(reasons == "")
    ts = quotes["timestamp_ns"].to_numpy()[passed]
    mid = ((quotes["bid"] + quotes["ask"]) / 2.0).to_numpy()[passed]
    flags = _signals(ts, mid, state, policy)

    # Quotes between two registrations meet one order.
    place = np.cumsum(~is_order)[is_order]
    starts = [0, *np.searchsorted(passed, place).tolist()]
    ends = [*starts[1:], len(passed)]
    registrations = [None, *frame[is_order][_ORDER].to_dict("records")]
    for order, first, last in zip(registrations, starts, ends):
        if order is not None:
            state.update(order, registered=int(order["registered"]), triggered=False)
        event = _risk_events(mid[first:last], state)
        if event is not None:
            events.iloc[passed[first + event[0]]] = list(event[1])

    reason = reasons.astype(object)
    reason[passed] = np.where(flags, ACCEPTED, DEBOUNCED)
    out["reason"] = reason
    out.loc[passed, "accepted_signal"] = flags
    out["kind"] = events["kind"]
    for name in ("trigger_price", "limit_price", "offset_bps"):
        out[name] = events[name].astype("float64")
    return out[_OUTPUT_COLUMNS]


def _to_bytes(frame: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _from_bytes(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas()


class _Symbols(StatefulProcessor):
    """Typed memory per symbol, and the parked rows of the trigger at work."""

    def __init__(self, policy: Policy, max_age: int, max_skew: int, idle_ms: int | None) -> None:
        self.rules = policy, max_age, max_skew
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.memory = handle.getValueState("memory", _STATE, self.idle_ms)
        self.parked = handle.getMapState("parked", "bucket long, part long", "rows binary")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues: TimerValues) -> None:
        found = {n: initialState[n].iloc[0] for n in STATE_COLUMNS}
        plain = [v.item() if isinstance(v, np.generic) else v for v in found.values()]
        state = dict(zip(STATE_COLUMNS, [None if pd.isna(v) else v for v in plain]))
        if state["side"] is None:
            state["registered"] = None
        self.memory.update(tuple(state.values()))

    def handleInputRows(
        self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues
    ) -> Iterator[pd.DataFrame]:
        state = dict(zip(STATE_COLUMNS, self.memory.get() if self.memory.exists() else _START))
        for frame in self._in_order(rows):
            yield _advance(key[0], frame, state, *self.rules)
        self.memory.update(tuple(state[n] for n in STATE_COLUMNS))

    def _in_order(self, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Parts of the trigger's rows, each behind the one before; one batch needs no parking."""
        first = next(rows, None)
        second = next(rows, None)
        if second is None:
            if first is not None:
                yield first
            return
        parts: dict[int, int] = {}
        for frame in chain([first, second], rows):
            for bucket, some in frame.groupby(frame["arrival"] // 2**PARKED_BITS):
                parts[int(bucket)] = part = parts.get(int(bucket), 0) + 1
                self.parked.updateValue((int(bucket), part), (_to_bytes(some),))
        for bucket in sorted(parts):
            keys = [(bucket, part) for part in range(1, parts[bucket] + 1)]
            yield pd.concat([_from_bytes(self.parked.getValue(k)[0]) for k in keys])
            for k in keys:
                self.parked.removeKey(k)


def process_stream(
    ticks: DataFrame,
    orders: DataFrame | None = None,
    policy: Policy | None = None,
    max_age_ns: int = MAX_QUOTE_AGE_NS,
    max_skew_ns: int = MAX_FUTURE_SKEW_NS,
    start: DataFrame | None = None,
    idle_ms: int | None = None,
) -> DataFrame:
    """Streaming `process`: outcome and risk event of every valid quote.

    `orders` is a second stream of registrations; both are keyed by symbol and share the
    arrival numbering.  `start` holds the state of symbols at the beginning, as
    `handover.state_after` makes it; a query that goes on from its checkpoint ignores it.
    With `idle_ms` the state of a symbol that brings no row for that long is forgotten: its
    next quote is treated like its first.  Spark then sees work in every trigger, so such a
    query needs an interval; one that runs until nothing is left would not end.  The session
    keeps state in RocksDB.
    """
    policy = policy or Policy("default")
    check_bounds(max_age_ns, max_skew_ns)
    if idle_ms is not None and idle_ms <= 0:
        raise ValueError("idle_ms must be positive")
    keep_state_on_disk(ticks.sparkSession)
    rows = validate_quotes(ticks)[0].select("symbol", *_QUOTE).withColumn("rank", F.lit(1))
    rows = rows.withColumn("received", F.col("receive_ns").isNotNull())
    blank = [F.lit(None).cast(t).alias(n) for n, t in zip(_ORDER, ["long", "string"] + ["double"] * 4)]
    rows = rows.select("*", *blank)
    if orders is not None:
        marks = oco_levels(validate_orders(orders)[0]).select(
            "symbol",
            F.col("registered_arrival").alias("arrival"),
            F.lit(0).alias("rank"),
            F.col("registered_arrival").alias("registered"),
            "side",
            "stop_price",
            "target_price",
            "limit_price",
            F.col("limit_offset_bps").alias("offset"),
            F.lit(False).alias("received"),
        )
        rows = rows.unionByName(marks, allowMissingColumns=True)
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in _NUMBERS})

    results = rows.groupBy("symbol").transformWithStateInPandas(
        _Symbols(policy, max_age_ns, max_skew_ns, idle_ms),
        _OUTPUT,
        "Append",
        "None" if idle_ms is None else "ProcessingTime",
        None if start is None else start.select("symbol", *STATE_COLUMNS).groupBy("symbol"),
    )
    price = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    event = F.struct(
        "kind", "symbol", price("trigger_price"), price("limit_price"), price("offset_bps")
    )
    return results.select(
        "symbol",
        *_QUOTE[:-1],
        F.when(F.col("received"), F.col("receive_ns")).alias("receive_ns"),
        "accepted_signal",
        "reason",
        F.when(F.col("kind").isNotNull(), event).alias("risk_event"),
    )

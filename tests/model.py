"""What the quote rules mean, stated over sets of earlier quotes and evaluated by brute force.

No state is carried from quote to quote: each rule looks at all earlier quotes of its symbol.
"""

from __future__ import annotations

import math


def usable(t):
    prices = (t["bid"], t["ask"])
    known = t["symbol"] is not None and t["symbol"].strip() and min(t["sequence"], t["timestamp_ns"]) >= 0
    return bool(known) and all(p is not None and math.isfinite(p) for p in prices) and 0 < prices[0] <= prices[1]


def mid(t):
    return (t["bid"] + t["ask"]) / 2.0


def age(t):
    return None if t["receive_ns"] is None else t["receive_ns"] - t["timestamp_ns"]


def gate_reasons(quotes, max_age, max_skew):
    """Reason per quote of one symbol, None for those that pass."""
    repeat = [any(e["sequence"] >= t["sequence"] for e in quotes[:i]) for i, t in enumerate(quotes)]
    stale = [age(t) is not None and age(t) > max_age for t in quotes]
    future = [age(t) is not None and -age(t) > max_skew for t in quotes]
    sound = [not any(marks) for marks in zip(repeat, stale, future)]
    late = [
        any(s and e["timestamp_ns"] > t["timestamp_ns"] for e, s in zip(quotes[:i], sound))
        for i, t in enumerate(quotes)
    ]
    names = ("duplicate_sequence", "out_of_order_timestamp", "stale_quote", "future_quote")
    return [
        next((name for name, broken in zip(names, marks) if broken), None)
        for marks in zip(repeat, late, stale, future)
    ]


def accepted(passing, p):
    """Is each passing quote of one symbol a signal?  One is if it lies in the block of no
    earlier sharp move or its own, and `base_ns` or more behind every earlier signal."""
    if p.passthrough:
        return [True] * len(passing)
    moves = [0.0] + [abs(mid(b) - mid(a)) / mid(a) * 10_000.0 for a, b in zip(passing, passing[1:])]
    ends = [
        t["timestamp_ns"] + min(p.max_ns, int(p.base_ns * (1.0 + move / p.stress_bps)))
        if i and move >= p.stress_bps
        else 0
        for i, (t, move) in enumerate(zip(passing, moves))
    ]
    signals = []
    for i, t in enumerate(passing):
        now = t["timestamp_ns"]
        free = all(now >= end for end in ends[: i + 1])
        signals.append(free and all(now >= e["timestamp_ns"] + p.base_ns for e, s in zip(passing, signals) if s))
    return signals


def levels(o):
    """Stop, target and limit price."""
    sign = {"long": 1.0, "short": -1.0}[o["side"]]
    stop = o["entry_price"] * (1.0 - sign * o["stop_bps"] / 10_000.0)
    target = o["entry_price"] * (1.0 + sign * o["take_profit_bps"] / 10_000.0)
    return stop, target, stop * (1.0 - sign * o["limit_offset_bps"] / 10_000.0)


def beyond(price, level, down):
    return price <= level if down else price >= level


def events(passing, orders):
    """{arrival: event}: the first passing quote beyond a level while its order is in force."""
    found = {}
    placed = sorted(orders, key=lambda o: o["registered_arrival"])
    ends = [o["registered_arrival"] for o in placed[1:]] + [math.inf]
    for o, end in zip(placed, ends):
        stop, target, limit = levels(o)
        down = o["side"] == "long"
        for t in passing:
            if not o["registered_arrival"] <= t["arrival"] < end:
                continue
            if beyond(mid(t), stop, down):
                found[t["arrival"]] = ("stop_triggered", stop, limit)
                break
            if beyond(mid(t), target, not down):
                found[t["arrival"]] = ("take_profit_triggered", target, None)
                break
    return found


def run(ticks, orders, policy, max_age, max_skew, gate=True):
    """{arrival: (accepted, reason, event)} over valid ticks."""
    out = {}
    valid = sorted(filter(usable, ticks), key=lambda t: t["arrival"])
    for symbol in {t["symbol"] for t in valid}:
        quotes = [t for t in valid if t["symbol"] == symbol]
        reasons = gate_reasons(quotes, max_age, max_skew) if gate else [None] * len(quotes)
        passing = [t for t, reason in zip(quotes, reasons) if reason is None]
        fired = events(passing, [o for o in orders if o["symbol"] == symbol])
        signals = dict(zip([t["arrival"] for t in passing], accepted(passing, policy)))
        for t, reason in zip(quotes, reasons):
            signal = signals.get(t["arrival"], False)
            reason = reason or ("accepted" if signal else "debounced")
            out[t["arrival"]] = (signal, reason, fired.get(t["arrival"]))
    return out

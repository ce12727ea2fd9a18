"""Building blocks of the SQL each registered query is compared with.

The SQL states the rules in plain window functions over whole tables; only the minimum
spacing of signals needs a recursive walk.
"""

from __future__ import annotations

import re

from tidegate.plans.events_view import LONG_COOLDOWN, MAX_AGE_NS, MAX_SKEW_NS, ORDERS, POLICIES, QUARTER_HOUR

_PRICE = "100.0 * (1.0 + (value - 50.0) * 1e-5)"

_ACTIVE = [p for p in POLICIES if not p.passthrough]



def _policy_values(policies) -> str:
    return ", ".join(f"('{p.name}', {p.base_ns}, {p.max_ns}, {p.stress_bps!r}::DOUBLE)" for p in policies)


_POLICY_VALUES = _policy_values(_ACTIVE)

_ORDER_VALUES = ", ".join(
    f"('{s}', '{oid}', {reg}, '{side}', {e}::DOUBLE, {st}::DOUBLE, {tp}::DOUBLE, {off}::DOUBLE)"
    for s, oid, reg, side, e, st, tp, off in ORDERS
)

_LEVELS = """
    entry_price * (1.0::DOUBLE - sgn * stop_bps / 10000.0::DOUBLE) AS stop_price,
    entry_price * (1.0::DOUBLE + sgn * take_profit_bps / 10000.0::DOUBLE) AS target_price,
    entry_price * (1.0::DOUBLE - sgn * stop_bps / 10000.0::DOUBLE)
        * (1.0::DOUBLE - sgn * limit_offset_bps / 10000.0::DOUBLE) AS limit_price
"""

LEVELS = _LEVELS

BLOCKS: dict[str, str] = {
    "clean": f"""
        SELECT event_type AS symbol, event_id AS sequence, epoch_us(ts) * 1000 AS timestamp_ns,
               {_PRICE} - 0.005::DOUBLE AS bid, {_PRICE} + 0.005::DOUBLE AS ask
        FROM events""",
    "copied": """
        SELECT *, 0 AS copy FROM clean
        UNION ALL
        SELECT *, 1 AS copy FROM clean WHERE sequence > 0 AND sequence % 97 = 0""",
    "shifted": """
        SELECT sequence * 2 + copy AS arrival, symbol, sequence,
               timestamp_ns - CASE WHEN sequence > 0 AND sequence % 211 = 0
                                   THEN 21600000000000 ELSE 0 END AS timestamp_ns,
               CASE WHEN sequence % 503 = 0 THEN 'nan'::DOUBLE ELSE bid END AS bid,
               CASE WHEN sequence % 499 = 0 THEN ask - 0.02::DOUBLE ELSE ask END AS ask
        FROM copied""",
    "ticks": """
        SELECT *, timestamp_ns + CASE WHEN sequence % 101 = 0 THEN 7200000000000
                                      WHEN sequence % 103 = 0 THEN -1800000000000
                                      ELSE 1000000000 END AS receive_ns
        FROM shifted""",
    "judged": """
        SELECT *, CASE WHEN symbol IS NULL OR trim(symbol) = '' THEN 'blank_symbol'
                       WHEN sequence IS NULL OR timestamp_ns IS NULL THEN 'missing_value'
                       WHEN sequence < 0 OR timestamp_ns < 0 THEN 'negative_value'
                       WHEN NOT isfinite(bid) OR NOT isfinite(ask) THEN 'non_finite_price'
                       WHEN bid <= 0 OR ask <= 0 THEN 'non_positive_price'
                       WHEN bid > ask THEN 'crossed_quote' END AS invalid_reason
        FROM ticks""",
    "valid": """
        SELECT arrival, symbol, sequence, timestamp_ns, bid, ask, receive_ns,
               (bid + ask) / 2.0::DOUBLE AS mid
        FROM judged WHERE invalid_reason IS NULL""",
    "sequenced": """
        SELECT *, sequence <= coalesce(max(sequence) OVER (
                      PARTITION BY symbol ORDER BY arrival
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS dup,
               receive_ns - timestamp_ns > {age} AS stale,
               receive_ns - timestamp_ns < -{skew} AS future
        FROM valid""".format(age=MAX_AGE_NS, skew=MAX_SKEW_NS),
    "timed": """
        SELECT *, max(CASE WHEN NOT dup AND NOT stale AND NOT future THEN timestamp_ns END) OVER (
                      PARTITION BY symbol ORDER BY arrival
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_ts
        FROM sequenced""",
    "gated": """
        SELECT arrival, symbol, sequence, timestamp_ns, bid, ask, receive_ns, mid,
               CASE WHEN dup THEN 'duplicate_sequence'
                    WHEN timestamp_ns < coalesce(last_ts, -1) THEN 'out_of_order_timestamp'
                    WHEN stale THEN 'stale_quote'
                    WHEN future THEN 'future_quote'
                    ELSE 'pass' END AS gate_reason
        FROM timed""",
    "moved": """
        SELECT *, abs(mid - previous_mid) / previous_mid * 10000.0::DOUBLE AS move_bps
        FROM (SELECT *, lag(mid) OVER (PARTITION BY symbol ORDER BY arrival) AS previous_mid
              FROM gated WHERE gate_reason = 'pass')""",
    "policies": f"""
        SELECT * FROM (VALUES {_POLICY_VALUES}) t(policy, base_ns, max_ns, stress_bps)""",
    "cooled": """
        SELECT *, CASE WHEN move_bps IS NULL THEN base_ns
                       ELSE least(max_ns, trunc(least(max_ns::DOUBLE,
                            base_ns::DOUBLE * (1.0::DOUBLE + move_bps / stress_bps)))::BIGINT)
                  END AS cooldown_ns
        FROM moved CROSS JOIN policies""",
    "blocking": """
        SELECT *, timestamp_ns < coalesce(max(CASE WHEN move_bps >= stress_bps
                                                   THEN timestamp_ns + cooldown_ns END) OVER (
                      PARTITION BY policy, symbol ORDER BY arrival
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS blocked
        FROM cooled""",
    "unblocked": """
        SELECT policy, symbol, arrival, timestamp_ns, base_ns,
               row_number() OVER (PARTITION BY policy, symbol ORDER BY arrival) AS rn
        FROM blocking WHERE NOT blocked""",
    "firsts": """
        SELECT policy, symbol, timestamp_ns, min(rn) AS rn FROM unblocked
        GROUP BY policy, symbol, timestamp_ns""",
    "nexts": """
        SELECT u.policy, u.symbol, u.rn, f.rn AS nr
        FROM (SELECT *, timestamp_ns + base_ns AS due FROM unblocked) u
        ASOF JOIN firsts f
        ON u.policy = f.policy AND u.symbol = f.symbol AND u.due <= f.timestamp_ns""",
    "chain": """
        SELECT DISTINCT policy, symbol, 1::BIGINT AS rn FROM unblocked
        UNION ALL
        SELECT c.policy, c.symbol, n.nr FROM chain c
        JOIN nexts n ON n.policy = c.policy AND n.symbol = c.symbol AND n.rn = c.rn""",
    "accepted": """
        SELECT u.policy, u.symbol, u.arrival FROM unblocked u
        JOIN chain c ON c.policy = u.policy AND c.symbol = u.symbol AND c.rn = u.rn""",
    "signals": """
        SELECT p.policy, g.*, CASE WHEN g.gate_reason <> 'pass' THEN FALSE
                                   WHEN p.policy = 'no debounce' THEN TRUE
                                   ELSE a.arrival IS NOT NULL END AS accepted_signal
        FROM (SELECT policy FROM policies UNION ALL SELECT 'no debounce') p
        CROSS JOIN gated g
        LEFT JOIN accepted a
        ON a.policy = p.policy AND a.symbol = g.symbol AND a.arrival = g.arrival""",
    "outcomes": """
        SELECT *, CASE WHEN gate_reason <> 'pass' THEN gate_reason
                       WHEN accepted_signal THEN 'accepted' ELSE 'debounced' END AS reason
        FROM signals""",
    "levels": f"""
        SELECT *, {_LEVELS}
        FROM (SELECT *, CASE WHEN side = 'long' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sgn
              FROM (VALUES {_ORDER_VALUES}) t(symbol, order_id, registered_arrival, side,
                    entry_price, stop_bps, take_profit_bps, limit_offset_bps))""",
    "moving_orders": """
        SELECT symbol, 'e' || sequence AS order_id, sequence * 2 + 1 AS registered_arrival,
               CASE WHEN sequence % 2 = 0 THEN 'long' ELSE 'short' END AS side,
               (bid + ask) / 2.0::DOUBLE AS entry_price,
               1.0::DOUBLE + (sequence % 7) AS stop_bps, 2.0::DOUBLE + (sequence % 5) AS take_profit_bps,
               (sequence % 3)::DOUBLE AS limit_offset_bps
        FROM clean""",
    "moving_levels": f"""
        SELECT *, {_LEVELS},
               lead(registered_arrival) OVER (PARTITION BY symbol ORDER BY registered_arrival)
                   AS replaced_arrival
        FROM (SELECT *, CASE WHEN side = 'long' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sgn
              FROM moving_orders)""",
    "in_force": """
        SELECT g.*, m.order_id, m.registered_arrival, m.side, m.stop_price, m.target_price,
               m.limit_price, m.limit_offset_bps
        FROM gated g ASOF LEFT JOIN moving_levels m
        ON g.symbol = m.symbol AND g.arrival >= m.registered_arrival""",
    "moving_hits": """
        SELECT *, CASE WHEN CASE side WHEN 'long' THEN mid <= stop_price ELSE mid >= stop_price END
                       THEN 'stop_triggered' ELSE 'take_profit_triggered' END AS kind,
               row_number() OVER (PARTITION BY symbol, order_id ORDER BY arrival) AS nth
        FROM in_force
        WHERE gate_reason = 'pass' AND order_id IS NOT NULL
          AND CASE side WHEN 'long' THEN mid <= stop_price OR mid >= target_price
                        ELSE mid >= stop_price OR mid <= target_price END""",
    "hits": """
        SELECT g.arrival, g.sequence, g.mid, o.*,
               CASE WHEN CASE o.side WHEN 'long' THEN g.mid <= o.stop_price
                                     ELSE g.mid >= o.stop_price END
                    THEN 'stop_triggered' ELSE 'take_profit_triggered' END AS kind,
               row_number() OVER (PARTITION BY o.order_id ORDER BY g.arrival) AS nth
        FROM gated g JOIN levels o ON g.symbol = o.symbol
        WHERE g.gate_reason = 'pass'
          AND CASE o.side WHEN 'long' THEN g.mid <= o.stop_price OR g.mid >= o.target_price
                          ELSE g.mid >= o.stop_price OR g.mid <= o.target_price END""",
    "triggers": """
        SELECT symbol, order_id, registered_arrival, arrival AS trigger_arrival,
               sequence AS trigger_sequence, mid AS trigger_mid, side, kind,
               CASE WHEN kind = 'stop_triggered' THEN stop_price ELSE target_price END AS trigger_price,
               CASE WHEN kind = 'stop_triggered' THEN limit_price END AS limit_price,
               CASE WHEN kind = 'stop_triggered' THEN limit_offset_bps ELSE 0.0 END AS offset_bps
        FROM hits WHERE nth = 1""",
    "messages": """
        SELECT event_id % 8 AS channel, event_id // 8 AS arrival,
               event_id // 8 + CASE WHEN event_id % 307 = 0 THEN 1 ELSE 0 END AS sequence,
               epoch_us(ts) * 1000 AS sent_ns,
               epoch_us(ts) * 1000 + CASE WHEN event_id % 401 = 0 THEN -5
                                          ELSE 2000 + (event_id * 7919) % 50000 END AS received_ns,
               epoch_us(ts) * 1000 + 60000 + (event_id * 104729) % 90000 AS acked_ns,
               props AS payload,
               CASE WHEN event_id % 409 = 0 THEN upper(props) || '!' ELSE props END AS reply
        FROM events""",
}

# The same walk over the clean stream without the gate, for the raw pipeline.
_WALK = ["gated", "moved", "cooled", "blocking", "unblocked", "firsts", "nexts", "chain", "hits"]
BLOCKS["raw_gated"] = """
    SELECT sequence AS arrival, symbol, sequence, timestamp_ns, bid, ask,
           (bid + ask) / 2.0::DOUBLE AS mid, 'pass' AS gate_reason
    FROM clean WHERE bid > 0 AND ask >= bid"""
for _name in _WALK[1:]:
    BLOCKS[f"raw_{_name}"] = re.sub(rf"\b({'|'.join(_WALK)})\b", r"raw_\1", BLOCKS[_name])

# And over the faulty stream, where a quote that goes back in time is set aside.
BLOCKS["guard_gated"] = """
    SELECT *, CASE WHEN timestamp_ns < max(timestamp_ns) OVER (
                   PARTITION BY symbol ORDER BY arrival
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
              THEN 'backwards_timestamp' ELSE 'pass' END AS gate_reason
    FROM (SELECT arrival, symbol, sequence, timestamp_ns, bid, ask, (bid + ask) / 2.0::DOUBLE AS mid
          FROM ticks WHERE isfinite(bid) AND isfinite(ask) AND bid > 0 AND ask >= bid)"""
for _name in _WALK[1:]:
    BLOCKS[f"guard_{_name}"] = re.sub(rf"\b({'|'.join(_WALK)})\b", r"guard_\1", BLOCKS[_name])

# And with all quotes under one symbol and a policy of long quiet periods.
BLOCKS["hot_gated"] = BLOCKS["raw_gated"].replace("AS arrival, symbol,", "AS arrival, 'all' AS symbol,")
BLOCKS["hot_policies"] = f"""
    SELECT * FROM (VALUES {_policy_values([LONG_COOLDOWN])}) t(policy, base_ns, max_ns, stress_bps)"""
for _name in [*_WALK[1:-1], "accepted"]:
    BLOCKS[f"hot_{_name}"] = re.sub(rf"\b({'|'.join([*_WALK, 'policies'])})\b", r"hot_\1", BLOCKS[_name])

# Rate limits from a table.  Each symbol's unblocked times are folded for each of them.
BLOCKS["table_settings"] = f"""
    SELECT 'customer ' || c_custkey AS policy, (1 + c_custkey % 97) * {QUARTER_HOUR} AS base_ns,
           (1 + c_custkey % 97) * (1 + c_custkey % 5) * {QUARTER_HOUR} AS max_ns,
           (2 + c_custkey % 60)::DOUBLE AS stress_bps
    FROM customer WHERE c_custkey % 50 <> 7"""
BLOCKS["table_ends"] = """
    SELECT policy, symbol, arrival, timestamp_ns, base_ns,
           coalesce(max(CASE WHEN move_bps >= stress_bps THEN timestamp_ns
                    + least(max_ns, trunc(least(max_ns::DOUBLE, base_ns::DOUBLE
                        * (1.0::DOUBLE + move_bps / stress_bps)))::BIGINT) END) OVER (
               PARTITION BY policy, symbol ORDER BY arrival
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS until
    FROM moved CROSS JOIN table_settings"""
BLOCKS["table_folds"] = """
    SELECT policy, symbol, list_reduce(
               list({'last': timestamp_ns, 'n': base_ns} ORDER BY arrival),
               lambda a, x: CASE WHEN x.last - a.last >= x.n THEN {'last': x.last, 'n': a.n + 1} ELSE a END,
               {'last': -4000000000000000000::BIGINT, 'n': 0::BIGINT}).n AS n
    FROM table_ends WHERE timestamp_ns >= until GROUP BY policy, symbol"""

# The order in which blocks must be defined.
_ORDER = list(BLOCKS)


def _needs(text: str) -> set[str]:
    words = set(re.findall(r"[a-z_]+", text))
    return {name for name in BLOCKS if name in words}


def sql(select: str) -> str:
    """The query with exactly the blocks it needs in front of it."""
    wanted, todo = set(), _needs(select)
    while todo:
        name = todo.pop()
        if name not in wanted:
            wanted.add(name)
            todo |= _needs(BLOCKS[name]) - wanted
    parts = []
    for name in _ORDER:
        if name in wanted:
            columns = "(policy, symbol, rn)" if name.endswith("chain") else ""
            # The walk joins this one once per step.
            stored = "MATERIALIZED " if name.endswith("nexts") else ""
            parts.append(f"{name}{columns} AS {stored}({BLOCKS[name]})")
    return f"WITH RECURSIVE {', '.join(parts)} {select}" if parts else select


def percentile(column: str, p: float) -> str:
    """floor((n - 1) * p) rank of a column as an aggregate."""
    return f"list_sort(list({column}))[(trunc((count({column}) - 1) * {p}::DOUBLE))::BIGINT + 1]"

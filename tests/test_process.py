"""The distributed pipeline against a plain loop, and the published vectors."""

import random

import pytest
from pyspark.sql import functions as F

import model
from tidegate.operators.debounce import debounce
from tidegate.operators.process import compare, process, raw_signals
from tidegate.operators.quality import (
    invalid_counts,
    monotonic_guard,
    quality_gate,
    validate_quotes,
    with_mid,
)
from tidegate.operators.risk import limit_marketable, oco_trigger, validate_orders
from tidegate.schema import ARRIVAL_SCHEMA, ORDER_SCHEMA, Policy

INF, NAN = float("inf"), float("nan")


def ticks_df(spark, rows):
    """Rows of (symbol, sequence, ts, bid, ask[, receive]); arrival is the position."""
    full = [(*r[:5], i, r[5] if len(r) > 5 else None) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, ARRIVAL_SCHEMA)


def at(mid, spread=0.1):
    return mid - spread, mid + spread


def outcomes(df):
    return [(r.accepted_signal, r.reason) for r in df.orderBy("arrival").collect()]


def test_validation(spark):
    rows = [
        ("X", 1, 10, 102.0, 101.0),
        ("X", 1, 10, NAN, 101.0),
        ("", 1, 10, 100.0, 101.0),
        ("\t  ", 1, 10, 100.0, 101.0),
        (None, 1, 10, 100.0, 101.0),
        ("X", -1, 10, 100.0, 101.0),
        ("X", 1, -10, 100.0, 101.0),
        ("X", None, 10, 100.0, 101.0),
        ("X", 1, 10, 100.0, INF),
        ("X", 1, 10, -INF, 100.0),
        ("X", 1, 10, None, 100.0),
        ("X", 1, 10, 0.0, 100.0),
        ("X", 1, 10, 1.7e308, 1.7e308),
        ("X", 1, 10, 99.0, 101.0),
    ]
    good, bad = validate_quotes(ticks_df(spark, rows))
    reasons = [r.invalid_reason for r in bad.orderBy("arrival").collect()]
    assert reasons == [
        "crossed_quote",
        "non_finite_price",
        "blank_symbol",
        "blank_symbol",
        "blank_symbol",
        "negative_value",
        "negative_value",
        "missing_value",
        "non_finite_price",
        "non_finite_price",
        "non_finite_price",
        "non_positive_price",
        "non_finite_mid",
    ]
    assert [r.mid for r in with_mid(good).collect()] == [100.0]
    assert sum(r.quotes for r in invalid_counts(ticks_df(spark, rows)).collect()) == len(rows)


@pytest.mark.parametrize("bits", ["auto", 0, 1])
@pytest.mark.parametrize(
    "policy, quotes, expected",
    [
        (Policy("p", 100, 100, 10.0), [(1000, 100), (1050, 100), (1100, 100)], "TFT"),
        (
            Policy("p", 100_000, 2_000_000, 5.0),
            [(1_000_000, 100), (1_200_000, 100), (1_300_000, 98), (2_000_000, 98), (3_300_000, 98)],
            "TTFFT",
        ),
        (
            Policy("p", 100_000, 2_000_000, 5.0),
            [(1_000_000, 100), (1_010_000, 100), (1_200_000, 100), (1_300_000, 98), (3_299_999, 98), (3_300_000, 98)],
            "TFTFFT",
        ),
        (Policy("p", 0, 0, 1e9), [(5, 100), (5, 100), (5, 100)], "TTT"),
        (Policy("p", 10, 10, 1e9), [(5, 100), (5, 101), (15, 100), (15, 100)], "TFTF"),
    ],
)
def test_debounce_vectors(spark, policy, quotes, expected, bits):
    df = ticks_df(spark, [("X", i, ts, *at(mid)) for i, (ts, mid) in enumerate(quotes)])
    rows = debounce(df.withColumn("gate_reason", F.lit("pass")), [policy], bits)
    flags = "".join("T" if a else "F" for a, _ in outcomes(rows))
    assert flags == expected


def test_symbols_are_independent(spark):
    df = ticks_df(spark, [("X", 1, 1000, *at(100.0)), ("Y", 1, 1000, *at(100.0))])
    assert [a for a, _ in outcomes(process(df, policy=Policy("p", 100, 100, 10.0)))] == [True, True]


def test_gate_vectors(spark):
    first = ("X", 1, 1_000_000, 99.9, 100.1, 1_000_500)
    df = ticks_df(spark, [first, first, ("X", 2, 900_000, 99.9, 100.1, 900_500)])
    found = [r for _, r in outcomes(process(df, max_age_ns=1_000_000))]
    assert found == ["accepted", "duplicate_sequence", "out_of_order_timestamp"]
    df = ticks_df(spark, [("X", 1, 100, 99.0, 100.0, 250), ("X", 2, 300, 99.0, 100.0, 200)])
    found = [r for _, r in outcomes(process(df, max_age_ns=100, max_skew_ns=20))]
    assert found == ["stale_quote", "future_quote"]
    # A repeat of a rejected quote is a repeat; both bounds are strict; no receive time, no age.
    rows = [
        ("X", 1, 100, 99.0, 100.0, 250),
        ("X", 1, 100, 99.0, 100.0, 110),
        ("X", 2, 200, 99.0, 100.0, 300),
        ("X", 3, 300, 99.0, 100.0, 280),
        ("X", 4, 400, 99.0, 100.0),
    ]
    gated = quality_gate(ticks_df(spark, rows), 100, 20)
    found = [r.gate_reason for r in gated.orderBy("arrival").collect()]
    assert found == ["stale_quote", "duplicate_sequence", "pass", "pass", "pass"]


def test_monotonic_guard(spark):
    df = ticks_df(spark, [("X", i, ts, *at(100.0)) for i, ts in enumerate([1000, 999, 1100])])
    for bits in ("auto", 0):
        flags = monotonic_guard(df, bits=bits).orderBy("arrival").collect()
        assert [r.backwards for r in flags] == [False, True, False]
    with pytest.raises(Exception, match="must not go back"):
        monotonic_guard(df, on_error="fail").collect()


def orders_df(spark, rows):
    return spark.createDataFrame(rows, ORDER_SCHEMA)


def order(symbol="X", side="long", at_=0, entry=100.0, stop=25.0, target=50.0, offset=5.0, name="o"):
    return (symbol, name, at_, side, entry, stop, target, offset)


def test_order_rules(spark):
    bad = [
        order(offset=10_000.0),
        order(stop=10_000.0),
        order(entry=0.0),
        order(entry=INF),
        order(side="flat"),
        order(offset=-1.0),
    ]
    good, rejected = validate_orders(orders_df(spark, [*bad, order()]))
    assert good.count() == 1 and rejected.count() == len(bad)


@pytest.mark.parametrize("side, mid, sign", [("long", 99.70, 1), ("short", 100.30, -1)])
def test_stop_limit_offset(spark, side, mid, sign):
    df = ticks_df(spark, [("X", 1, 1, *at(mid)), ("X", 2, 2, *at(100.6)), ("X", 3, 3, *at(mid))])
    rows = process(df, orders_df(spark, [order(side=side)])).orderBy("arrival").collect()
    event = rows[0].risk_event
    assert event.kind == "stop_triggered" and event.symbol == "X"
    gap = sign * (event.trigger_price - event.limit_price) / event.trigger_price * 10_000
    assert gap == pytest.approx(5.0)
    assert rows[1].risk_event is None and rows[2].risk_event is None


def test_gap_beyond_limit_is_not_marketable(spark):
    quotes = ticks_df(spark, [("X", i, i, *at(m)) for i, m in enumerate([100.0, 98.2, 99.72])])
    gated = quality_gate(quotes)
    orders = orders_df(spark, [order()])
    rows = limit_marketable(oco_trigger(gated, orders), quotes, orders).orderBy("arrival").collect()
    assert [r.marketable for r in rows] == [False, False, True]


def test_replaced_order_is_not_marketable(spark):
    quotes = ticks_df(spark, [("X", i, i, *at(m)) for i, m in enumerate([98.2, 99.72, 99.72])])
    orders = orders_df(spark, [order(), order(at_=2, stop=500.0, target=500.0, name="n")])
    triggers = oco_trigger(quality_gate(quotes), orders)
    rows = limit_marketable(triggers, quotes, orders).orderBy("arrival").collect()
    assert [(r.order_id, r.marketable) for r in rows] == [("o", False), ("o", True), ("n", False)]


def test_stop_fires_on_a_debounced_quote(spark):
    df = ticks_df(spark, [("X", 1, 1_000_000, 99.9, 100.1), ("X", 2, 1_010_000, 98.1, 98.3)])
    rows = process(df, orders_df(spark, [order()]), Policy("p", 1_000_000, 2_000_000, 5.0))
    first, second = rows.orderBy("arrival").collect()
    assert first.accepted_signal and not second.accepted_signal
    assert second.risk_event.kind == "stop_triggered"


def random_stream(seed, symbols=60, rows=2400):
    rng = random.Random(seed)
    clock, seqs, ticks = {}, {}, []
    for arrival in range(rows):
        s = "hot" if rng.random() < 0.35 else f"s{rng.randrange(symbols)}"
        seqs[s] = max(0, seqs.get(s, 0) + rng.choice([1, 1, 1, 2, 0, -1]))
        clock[s] = max(0, clock.get(s, 0) + rng.choice([0, 1, 3, 10, 40, -15]))
        mid = 100.0 + rng.choice([0, 0, 0.01, -0.02, 0.3, -0.4])
        bid = rng.choice([NAN, None, -1.0]) if rng.random() < 0.03 else mid - 0.01
        receive = None if rng.random() < 0.2 else clock[s] + rng.choice([0, 5, 30, 200, -50])
        ticks.append(
            dict(symbol=s, sequence=seqs[s], timestamp_ns=clock[s], bid=bid, ask=mid + 0.01,
                 arrival=arrival, receive_ns=receive)
        )
    orders, used = [], set()
    for i in range(rows // 12):
        s = "hot" if rng.random() < 0.5 else f"s{rng.randrange(symbols)}"
        when = rng.randrange(rows)
        if (s, when) in used:
            continue
        used.add((s, when))
        orders.append(
            dict(symbol=s, order_id=f"o{i}", registered_arrival=when,
                 side=rng.choice(["long", "short"]), entry_price=100.0,
                 stop_bps=rng.choice([1.0, 3.0, 25.0]), take_profit_bps=rng.choice([1.0, 2.0, 25.0]),
                 limit_offset_bps=rng.choice([0.0, 5.0]))
        )
    return ticks, orders


POLICIES = [
    Policy("pass", passthrough=True),
    Policy("zero", 0, 50, 5.0),
    Policy("fixed", 20, 20, 1e9),
    Policy("adaptive", 15, 120, 10.0),
    Policy("long", 5_000, 9_000, 30.0),
]


@pytest.mark.parametrize("bits", ["auto", 2, 5])
@pytest.mark.parametrize("seed", [1, 2])
def test_pipeline_equals_plain_loop(spark, seed, bits):
    ticks, orders = random_stream(seed)
    rows = compare(
        spark.createDataFrame(ticks, ARRIVAL_SCHEMA),
        spark.createDataFrame(orders, ORDER_SCHEMA),
        POLICIES,
        100,
        20,
        bits,
    ).collect()
    by_policy = {}
    for r in rows:
        event = r.risk_event and (r.risk_event.kind, r.risk_event.trigger_price, r.risk_event.limit_price)
        by_policy.setdefault(r.policy, {})[r.arrival] = (r.accepted_signal, r.reason, event)
    for p in POLICIES:
        assert by_policy[p.name] == model.run(ticks, orders, p, 100, 20)


@pytest.mark.parametrize("bits", ["auto", 3])
def test_raw_signals_equal_plain_loop(spark, bits):
    ticks, orders = random_stream(3)
    latest = {}
    for t in ticks:
        t["timestamp_ns"] = latest[t["symbol"]] = max(t["timestamp_ns"], latest.get(t["symbol"], 0))
    policy = POLICIES[3]
    rows = raw_signals(
        spark.createDataFrame(ticks, ARRIVAL_SCHEMA),
        spark.createDataFrame(orders, ORDER_SCHEMA),
        [policy],
        bits,
    ).collect()
    expected = model.run(ticks, orders, policy, 0, 0, gate=False)
    assert {r.arrival: r._accepted_0 for r in rows} == {a: e[0] for a, e in expected.items()}
    fired = {r.arrival: r.risk_event.kind for r in rows if r.risk_event}
    assert fired == {a: e[2][0] for a, e in expected.items() if e[2]}


def test_policy_rules():
    for wrong in ({"base_ns": -1}, {"base_ns": 5, "max_ns": 4}, {"stress_bps": 0.0}, {"stress_bps": INF}):
        with pytest.raises(ValueError):
            Policy("p", **wrong)


def test_raw_signals_set_aside_backward_times(spark):
    times = [1000, 500, 600, 1100, 1200]
    rows = [("X", i, t, 99.0, 101.0, i, None) for i, t in enumerate(times)]
    stream = spark.createDataFrame(rows, ARRIVAL_SCHEMA)
    policy = Policy("p", 100, 100, 1e9)
    for bits in ("auto", 1):
        found = raw_signals(stream, None, [policy], bits).orderBy("arrival").collect()
        assert [r._accepted_0 for r in found] == [True, False, False, True, True]
        assert [r.gate_reason == "backwards_timestamp" for r in found] == [False, True, True, False, False]
    with pytest.raises(Exception, match="must not go back"):
        raw_signals(stream, None, [policy], on_backwards="fail").collect()

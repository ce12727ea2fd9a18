"""Step functions of buckets against the plain rule."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import model
from tidegate.operators import debounce, spacing
from tidegate.schema import ARRIVAL_SCHEMA, Policy


def plain(ts, base, last, blocked):
    for t in ts:
        if t >= blocked and (last == spacing.NEVER or t - last >= base):
            last = t
    return last


def test_steps_of_buckets_compose():
    rng = random.Random(7)
    for _ in range(3000):
        base = rng.choice([1, 3, 10, 40])
        ts, t = [], 0
        for _ in range(rng.randrange(1, 25)):
            t += rng.choice([0, 1, 2, 5, 30])
            ts.append(t)
        cuts = sorted(rng.randrange(len(ts) + 1) for _ in range(rng.randrange(4)))
        parts = [p for p in np.split(np.array(ts, dtype=np.int64), cuts) if len(p)]
        total, last, until = ([], []), spacing.NEVER, 0
        for part in parts:
            longest = max(base, 20)
            until = max(until, rng.choice([0, 0, int(part[0]) + rng.randrange(longest)]))
            steps = spacing.signal_steps(
                spacing.threshold_steps(part, base, int(part[0]) + longest), base, until, int(part[0])
            )
            expected = plain(part.tolist(), base, last, until)
            assert spacing.apply_steps(steps, last) == expected
            chain = spacing.accepted_rows(part, base, spacing.entry_threshold(last, base, until))
            assert (int(part[chain[-1]]) if chain else last) == expected
            total = spacing.compose_steps(total, steps)
            last = expected
            assert spacing.apply_steps(total, spacing.NEVER) == last


def test_block_end_saturates():
    ts = np.array([spacing.ALWAYS - 5, spacing.ALWAYS - 1], dtype=np.int64)
    ends = spacing.block_ends(ts, np.array([100.0, 50.0]), 100, 1000, 5.0, None)
    assert ends.tolist() == [0, spacing.ALWAYS]


def test_steps_stay_small_on_even_spacing():
    ts = np.arange(0, 100_000, 10, dtype=np.int64)
    upto, exits = spacing.threshold_steps(ts, 100, 200)
    assert len(upto) == 21 and len(set(exits)) == 10


def passing_quotes(spark, seed, rows, step, symbols=("hot",)):
    """Quotes in time order, many of them at one time, with a sharp move now and then."""
    rng = random.Random(seed)
    ticks, clock = [], 0
    for i in range(rows):
        clock += rng.choice([0, step, step, 2 * step, 5 * step])
        mid = 100.0 + rng.choice([0, 0, 0, 0, 0.3])
        ticks.append(dict(symbol=rng.choice(symbols), sequence=i, timestamp_ns=clock, bid=mid, ask=mid, arrival=i, receive_ns=None))
    return ticks, spark.createDataFrame(ticks, ARRIVAL_SCHEMA).withColumn("gate_reason", F.lit("pass"))


LONG = [
    Policy("short", 3, 40, 1e9),
    Policy("long", 400, 400, 1e9),
    Policy("longer", 3_000, 9_000, 20.0),
    Policy("zero", 0, 700, 20.0),
]


@pytest.mark.parametrize("bits, steps", [(3, 1), (4, 16), (6, 200)])
def test_signals_carried_through_many_groups(spark, bits, steps):
    """Quiet periods of many buckets, groups of few steps, two symbols of unlike size."""
    ticks, quotes = passing_quotes(spark, bits, 900, 2, ("hot", "hot", "cold"))
    rows = debounce.debounce(quotes, LONG, bits, steps).collect()
    found = {(r.policy, r.arrival): r.accepted_signal for r in rows}
    for p in LONG:
        expected = model.run(ticks, [], p, 0, 0, gate=False)
        assert {a: found[p.name, a] for a in expected} == {a: e[0] for a, e in expected.items()}


def test_carried_bytes_stay_bounded(spark, monkeypatch):
    """However long the quiet period and hot the symbol, a call gets a bounded number of steps."""
    seen = []
    own = debounce._carried_signals

    def watched(steps, layout, several):
        size = steps.groupBy("symbol", "_policy", "_group").agg(F.sum(F.size("upto")).alias("n"), F.count("*").alias("b"))
        seen.append((*size.agg(F.max("n"), F.max(F.when(F.col("b") > 1, F.col("n")))).first(), several))
        return own(steps, layout, several)

    monkeypatch.setattr(debounce, "_carried_signals", watched)
    _, quotes = passing_quotes(spark, 9, 6_000, 10)
    for base in (20, 5_000, 10**9):
        debounce.debounce(quotes, [Policy("p", base, base, 1e9)], bits=6, steps_per_call=256).count()
    assert all(largest <= 256 and (of_many or 0) <= 256 for largest, of_many, _ in seen)
    assert [several for *_, several in seen] == [False, True, True]

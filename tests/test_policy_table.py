"""Rate limits from a table against brute force, in blocks, and with odd tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import model
from tidegate.operators import policy_table, spacing
from tidegate.schema import Policy
from test_spacing import passing_quotes

TABLE = "policy string, base_ns bigint, max_ns bigint, stress_bps double, desk string"


def made(spark, seed, rows):
    rng = random.Random(seed)
    out = []
    for i in range(rows):
        base = rng.choice([0, 1, 7, 40, 500, 3_000])
        out.append((f"p{i}", base, base + rng.choice([0, 30, 4_000]), rng.choice([5.0, 20.0, 1e9]), f"desk {i % 3}"))
    return out, spark.createDataFrame(out, TABLE)


@pytest.mark.parametrize("bits, steps", [(4, 16), (14, 2**15)])
def test_signals_equal_brute_force(spark, monkeypatch, bits, steps):
    monkeypatch.setattr(policy_table, "BLOCK", 4)
    ticks, quotes = passing_quotes(spark, bits, 400, 2, ("hot", "hot", "cold"))
    settings, policies = made(spark, bits, 21)
    found = {}
    for r in policy_table.table_signals(quotes, policies, bits, steps).collect():
        found.setdefault(r.policy, set()).add(r.arrival)
    report = {r.policy: r for r in policy_table.table_metrics(quotes, policies, bits, steps).collect()}
    assert len(report) == 21
    for name, base, longest, stress, desk in settings:
        rows = model.run(ticks, [], Policy(name, base, longest, stress), 0, 0, gate=False)
        expected = {a for a, e in rows.items() if e[0]}
        assert found[name] == expected
        assert report[name].accepted_signals == len(expected)
        assert report[name].debounced_signals == len(ticks) - len(expected)
        assert report[name].desk == desk and report[name].input_events == len(ticks)


def test_rows_with_equal_names_are_policies_of_their_own(spark):
    _, quotes = passing_quotes(spark, 1, 60, 2)
    policies = spark.createDataFrame([("a", 0, 0, 1.0, "x"), ("a", 0, 0, 1.0, "x"), ("a", 10**9, 10**9, 1e9, "y")], TABLE)
    rows = policy_table.table_metrics(quotes, policies, 4).collect()
    assert sorted(r.accepted_signals for r in rows) == [1, 60, 60]


def test_empty_tables(spark):
    _, quotes = passing_quotes(spark, 2, 40, 2)
    _, policies = made(spark, 2, 3)
    assert policy_table.table_metrics(quotes, policies.where("false"), 4).count() == 0
    assert policy_table.table_signals(quotes, policies.where("false"), 4).count() == 0
    none = quotes.where("false")
    assert [r.accepted_signals for r in policy_table.table_metrics(none, policies, 4).collect()] == [0] * 3
    assert policy_table.table_signals(none, policies).count() == 0


def test_symbols_without_passing_quotes(spark):
    _, quotes = passing_quotes(spark, 3, 40, 2)
    late = quotes.withColumn("gate_reason", F.lit("stale_quote"))
    _, policies = made(spark, 3, 3)
    rows = policy_table.table_metrics(late, policies, 4).collect()
    assert {(r.accepted_signals, r.stale_quotes, r.signal_reduction_pct) for r in rows} == {(0, 40, 0.0)}


@pytest.mark.parametrize("wide", [16, 10**6])
def test_many_policies_widen_buckets(spark, monkeypatch, wide):
    """Buckets of a long table are joined, so that little or nothing is handed on."""
    monkeypatch.setattr(policy_table, "HANDED_ROWS", 0)
    monkeypatch.setattr(policy_table, "WIDE_ROWS", wide)
    summaries = []
    summary = policy_table._carried
    monkeypatch.setattr(policy_table, "_carried", lambda rows, *a: summaries.append(rows.count()) or summary(rows, *a))
    ticks, quotes = passing_quotes(spark, 9, 300, 2, ("hot", "hot", "cold"))
    settings, policies = made(spark, 9, 12)
    report = {r.policy: r for r in policy_table.table_metrics(quotes, policies, 2, 64).collect()}
    for name, base, longest, stress, _ in settings:
        rows = model.run(ticks, [], Policy(name, base, longest, stress), 0, 0, gate=False)
        assert report[name].accepted_signals == sum(e[0] for e in rows.values())
    assert [n < 12 * 60 for n in summaries] == ([True] if wide == 16 else [])


@pytest.mark.parametrize("wide", [16, 64])
def test_a_long_table_hands_on_no_step_functions(spark, monkeypatch, wide):
    """Its buckets follow each other in a task, a block of policies at a time."""
    monkeypatch.setattr(policy_table, "BLOCK", 4)
    monkeypatch.setattr(policy_table, "HANDED_ROWS", 0)
    monkeypatch.setattr(policy_table, "WIDE_ROWS", wide)
    monkeypatch.setattr(policy_table, "_carried", lambda *a: pytest.fail("step functions were made"))
    ticks, quotes = passing_quotes(spark, 5, 300, 2, ("hot", "hot", "cold"))
    settings, policies = made(spark, 5, 21)
    found = {}
    for r in policy_table.table_signals(quotes, policies, 2).collect():
        found.setdefault(r.policy, set()).add(r.arrival)
    report = {r.policy: r for r in policy_table.table_metrics(quotes, policies, 2).collect()}
    for name, base, longest, stress, _ in settings:
        rows = model.run(ticks, [], Policy(name, base, longest, stress), 0, 0, gate=False)
        assert found[name] == {a for a, e in rows.items() if e[0]}
        assert report[name].accepted_signals == len(found[name])


def test_open_ranges_and_chains_equal_the_walk_over_all_quotes():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        ts = np.cumsum(rng.choice([0, 1, 5, 60], n)).astype(np.int64)
        mid = 100.0 + rng.choice([0.0, 0.01, 0.05, 0.3], n)
        base = int(rng.choice([0, 1, 7, 90]))
        longest, stress = base + int(rng.choice([0, 30, 400])), float(rng.choice([1.0, 4.0, 20.0]))
        before, blocked = rng.choice([None, 100.1]), int(rng.choice([0, 40]))
        ends = np.maximum(spacing.block_ends(ts, mid, base, longest, stress, before), blocked)
        open_ = np.flatnonzero(ts >= ends)
        first, behind, end = spacing.open_ranges(ts, spacing.moves(mid, before), base, longest, stress, blocked)
        assert spacing.rows_of(first, behind, n).tolist() == open_.tolist() and end == ends[-1]
        entry = int(rng.choice([spacing.NEVER, 20]))
        expected = open_[spacing.accepted_rows(ts[open_], base, entry)].tolist()
        found = spacing.accepted_in_ranges(ts, ts.tolist(), first, behind, base, entry)
        assert list(found) == expected

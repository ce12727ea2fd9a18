"""Published counts of the replay streams, and the plans behind them."""

import pytest

from pyspark.sql import DataFrameWriter

from tidegate.functions.quotes import sample_stride, warmup_rows
from tidegate.operators import debounce, scan
from tidegate.operators.metrics import EventWindow
from tidegate.operators.process import evaluate
from tidegate.operators.quality import arranged_gate, mark_gate, sequence_scan
from tidegate.operators.scan import Layout, bucket_bits, plan_layout, running
from tidegate.plans import catalog, experiment
from tidegate.schema import MAX_POLICIES, REPLAY_POLICIES, Policy
from tidegate.sources import replay


def replay_stream(spark, n):
    return replay.inject_faults(replay.replay_ticks(spark, n))


@pytest.mark.parametrize("bits", ["auto", 13])
def test_replay_counts(spark, bits):
    report = experiment.compare_policies(
        replay_stream(spark, 100_000),
        experiment.replay_orders(spark),
        window=EventWindow.after_switch(100_000),
        probe_mid=98.2,
        bits=bits,
    ).collect()
    for r in report:
        assert r.input_events == 101_030 and r.duplicate_sequences == 1_030
        assert r.out_of_order_timestamps == 473 and r.stale_quotes == 100 and r.future_quotes == 0
        assert r.stop_triggers == 1 and not r.stop_limit_marketable_at_crash
        assert r.post_crash_window_start_sequence == 55_000
        assert r.post_crash_window_valid_quotes == 199
    counts = [
        (r.accepted_signals, r.debounced_signals, r.post_crash_window_accepted_signals) for r in report
    ]
    assert counts == [(99_427, 0, 199), (9_953, 89_474, 20), (9_934, 89_493, 0)]


def test_more_policies_than_one_plan_holds(spark):
    policies = [Policy(f"p{i}", 100_000 + i, 200_000, 5.0) for i in range(MAX_POLICIES + 2)]
    stream = replay_stream(spark, 2_000)
    report = {r.policy: r for r in experiment.compare_policies(stream, None, policies).collect()}
    one = experiment.compare_policies(stream, None, policies[-1:]).first()
    assert len(report) == len(policies) and report[one.policy] == one


def test_raw_pipeline_count(spark):
    row = experiment.raw_pipeline(
        replay.raw_replay(spark, 1_000_000), experiment.replay_orders(spark), bits=15
    ).first()
    assert (row.signals_accepted, row.signals_debounced) == (99_980, 900_020)
    assert row.stop_triggers == 1 and not row.stop_limit_marketable_at_gap
    assert (row.warmup_ticks, row.measured_ticks) == (10_000, 990_000)
    assert row.latency_sample_count == 19_800 and row.invalid_ticks == 0


def test_replay_is_repeatable_and_rejects_nothing(spark):
    a, b = replay_stream(spark, 500), replay_stream(spark, 500)
    assert a.exceptAll(b).count() == 0 and a.count() == 505
    arrivals = [r.arrival for r in a.select("arrival").orderBy("arrival").collect()]
    assert arrivals == list(range(505))
    with pytest.raises(ValueError):
        replay.replay_ticks(spark, 0)
    assert EventWindow.after_switch(100) == EventWindow(55, 45)


def test_sampled_latency_after_warmup(spark):
    n = 50_000
    stride, warmup = sample_stride(n), warmup_rows(n)
    assert (stride, warmup, sample_stride(10), warmup_rows(10**6)) == (2, 5_000, 1, 10_000)
    stream = replay_stream(spark, n)
    row = experiment.quote_latency(stream, ["symbol"], stride, warmup).first()
    assert (row.p50_us, row.p95_us) == (1.0, 1.0)
    late = experiment.quote_latency(stream.where("arrival % 997 = 0"), [], 1, warmup).first()
    assert late.p50_us == 10_000.0
    with pytest.raises(ValueError):
        experiment.quote_latency(stream, [], 0)


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_over_arranged_rows_shuffle_only_carried_values(spark):
    layout = Layout(bits=12)
    rows = layout.start(replay_stream(spark, 20_000))
    gated = mark_gate(running(rows, layout, sequence_scan()), layout, 5_000_000, 1_000_000)
    plan = executed(gated)
    assert plan.count("ShuffledHashJoin") == 2 and "Broadcast" not in plan
    # One exchange per carried table, none for the rows, which are not sorted again either.
    assert plan.count("Exchange hashpartitioning") == 2 and "Bucketed: true" in plan
    assert "Sort [" not in plan and "SortMergeJoin" not in plan


def test_one_write_for_all_scans(spark, monkeypatch):
    """The whole pipeline writes the stream once and reads it where it lies."""
    written = []
    save = DataFrameWriter.saveAsTable
    monkeypatch.setattr(DataFrameWriter, "saveAsTable", lambda w, name: written.append(name) or save(w, name))
    cut_rows = []
    for module in (scan, debounce):
        own = module.cut
        monkeypatch.setattr(module, "cut", lambda df, own=own: cut_rows.append(own(df)) or cut_rows[-1])
    n = 30_000
    orders = experiment.replay_orders(spark)
    rows = evaluate(replay_stream(spark, n), orders, REPLAY_POLICIES, bits=12)
    assert len(written) == 1
    # What is checkpointed on the way are rows per bucket, never the stream.
    assert max(df.count() for df in cut_rows) <= 2 * (2 * n >> 12)
    plan = executed(rows)
    assert "Sort [" not in plan and "SortMergeJoin" not in plan
    assert plan.count("Exchange") == plan.count("ShuffledHashJoin") == 3  # carried values


def test_one_table_for_several_operators(spark):
    stream = arranged_gate(replay_stream(spark, 5_000), bits=10)
    moved = debounce.with_previous_mid(stream)
    signals = debounce.debounce(stream, REPLAY_POLICIES[1:])
    assert moved.count() == 5_051 and signals.count() == 2 * 5_051
    names = {line.split("spark_catalog.default.")[1].split("[")[0] for df in (moved, signals)
             for line in executed(df).splitlines() if "FileScan" in line}
    assert len(names) == 1


def test_layout_follows_the_table(spark):
    small = replay_stream(spark, 20_000)
    assert plan_layout(small).bits == 14 and plan_layout(small, 7).bits == 7
    assert plan_layout(small.limit(0)).bits == Layout().bits
    million = 10**6
    assert bucket_bits(2**17, 2**17, 2**17) == 14 and bucket_bits(million, million, million) == 14
    # One symbol only; a third in one symbol; ten thousand even symbols; sparse numbering.
    assert bucket_bits(10 * million, 10 * million, 10 * million) == 14
    assert bucket_bits(9 * million, 3 * million, 9 * million) == 16
    assert bucket_bits(10**12, 10**8, 10**12) == 20
    assert bucket_bits(10**9, 10**9, 10**12) == 24


@pytest.mark.parametrize("place", ["id", "if(id = 0, 1000000000000, id)", "id + id div 1000 * 100000000000"])
def test_buckets_stay_bounded_whatever_the_numbering(spark, place):
    """Dense arrivals, one of them far off, and bursts between long pauses."""
    rows = spark.range(400_000).selectExpr("'X' as symbol", f"{place} as arrival")
    layout = plan_layout(rows)
    sizes = layout.assign(rows).groupBy("symbol", "_bucket").count().agg({"count": "max"}).first()[0]
    assert sizes <= 2**15


def test_scan_reads_only_needed_columns(spark):
    plan = executed(catalog.event_rate(spark, "/root/testdata/sf0.001"))
    read = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "value" not in read and "props" not in read and "user_id" not in read

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidegate.operators import audit, checks, compare, grid, messages, metrics, percentiles
from tidegate.schema import MESSAGE_SCHEMA


@pytest.mark.parametrize("scale", [1, 1 << 30, 1 << 50])
def test_lower_rank_percentiles(spark, scale):
    rng = random.Random(scale)
    data = {g: [rng.randrange(-50, 50) * scale + rng.randrange(3) for _ in range(n)]
            for g, n in (("a", 10), ("b", 1), ("c", 997))}
    rows = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs] + [("a", None)], "g string, v bigint")
    ranks = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    for r in percentiles.lower_rank_percentiles(rows, ["g"], "v", ranks).collect():
        ordered = sorted(data[r.g])
        for name, p in ranks.items():
            assert r[name] == ordered[min(len(ordered) - 1, math.floor((len(ordered) - 1) * p))]
    whole = percentiles.lower_rank_percentiles(rows, [], "v", {"m": 0.5}).first()
    everything = sorted(v for vs in data.values() for v in vs)
    assert whole.m == everything[math.floor((len(everything) - 1) * 0.5)]


def test_exact_median_of_doubles(spark):
    rng = random.Random(1)
    data = {"odd": [rng.uniform(-5, 5) for _ in range(7)], "even": [rng.uniform(-1e9, 1e9) for _ in range(12)],
            "zero": [0.0, -0.0, 1.5, -2.5]}
    rows = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs], "g string, v double")
    found = {r.g: r.v for r in percentiles.exact_median(rows, ["g"], "v").collect()}
    assert found == {g: statistics.median(vs) for g, vs in data.items()}


def test_median_of_repeats_takes_other_fields_from_the_middle_run(spark):
    rows = spark.createDataFrame([("x", i, t, i * 10) for i, t in enumerate([3.0, 1.0, 2.0, 9.0])],
                                 "s string, run int, t double, n int")
    row = compare.median_of_repeats(rows, ["s"], "run", ["t"], ["n"]).first()
    assert (row.t, row.n, row.measured_repeats) == (2.5, 20, 4)
    same = compare.repeat_invariance(rows.withColumn("k", F.lit(1)), ["s"], ["n", "k"]).collect()
    assert {r.counter: r.invariant for r in same} == {"n": False, "k": True}


def test_grid_boundary(spark):
    cells = grid.gap_grid(spark.createDataFrame([(100.0,)], "entry_price double"))
    fillable = cells.where("offset_bps = 5 AND marketable").collect()
    assert sorted(r.gap_bps for r in fillable) == [0.0, 1.0, 2.0, 5.0]
    counts = {r.offset_bps: r.n for r in cells.groupBy("offset_bps").agg(F.count_if("marketable").alias("n")).collect()}
    assert counts == {0.0: 1, 5.0: 4, 10.0: 6}
    assert checks.failures(checks.grid_checks(cells, [])).count() == 0
    broken = cells.withColumn("marketable", F.col("marketable") | (F.col("gap_bps") == 50.0))
    names = {r.check for r in checks.failures(checks.grid_checks(broken, [])).collect()}
    assert names == {"grid_flags_recompute"}
    returning = cells.withColumn("observed_price", F.when(F.col("gap_bps") == 50.0, 1e3).otherwise(F.col("observed_price")))
    found = grid.boundary_check(returning, []).where("returns_true").count()
    assert found == 3


def test_message_report_counts_faults(spark):
    rows = [(i, 1000 * i + 1, 1000 * i + 4001 + i, 1000 * i + 9001, "m", "m") for i in range(20)]
    log = spark.createDataFrame(rows, MESSAGE_SCHEMA).withColumns({"arrival": F.col("sequence"), "c": F.lit(1)})
    report = messages.message_report(log, ["c"], warmup=4, bits=2).first()
    assert (report.measured_messages, report.timed_sample_count) == (16, 16)
    assert report.p50_one_way_us == (4000 + 4 + 7) / 1000.0 and report.max_one_way_us == 4.019
    assert report.payload_check == "passed" and report.sub_10_us_p50
    assert report.throughput_messages_per_second == pytest.approx(16 / (15 * 1001 / 1e9))
    bad = log.withColumns({
        "sequence": F.when(F.col("arrival") == 6, 99).otherwise(F.col("sequence")),
        "received_ns": F.when(F.col("arrival") == 7, 0).when(F.col("arrival") == 8, None).otherwise(F.col("received_ns")),
        "reply": F.when(F.col("arrival") == 9, "?").otherwise(F.col("reply")),
    })
    report = messages.message_report(bad, ["c"], warmup=4).first()
    assert (report.bad_sequences, report.invalid_timestamps, report.bad_payloads) == (1, 2, 1)
    assert report.timed_sample_count == 14 and report.payload_check == "failed"
    failed = checks.failures(checks.message_checks(messages.message_report(bad, ["c"]), F.col("c")))
    assert {r.check for r in failed.collect()} == {
        "samples_match", "payload_passed", "no_bad_sequences", "no_invalid_timestamps"}


def test_payload_check_counts_repeated_keys(spark):
    sent = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "c"), (5, "e")], "k int, payload string")
    back = spark.createDataFrame([(1, "a"), (1, "a"), (2, "x"), (4, "d"), (5, "e"), (5, "e")], "k int, reply string")
    found = {r.k: r.status for r in messages.payload_check(sent, back, ["k"]).collect()}
    assert found == {1: "ok", 2: "mismatch", 3: "missing_reply", 4: "unexpected_reply", 5: "mismatch"}


def test_parity_and_reconcile(spark):
    a = spark.createDataFrame([(0, "p", 1), (1, "q", None)], "pos int, name string, n int")
    b = spark.createDataFrame([(0, "p", 1), (1, "q", 2), (2, "r", 3)], "pos int, name string, n int")
    parity = compare.parity_check(a, b, ["pos"], ["name", "n"])
    found = {(r.pos, r.check): r.match for r in parity.collect()}
    assert found == {(0, "name"): True, (0, "n"): True, (1, "name"): True, (1, "n"): False,
                     (2, "name"): False, (2, "n"): False}
    assert compare.parity_summary(parity, []).first().mismatches == 3
    assert compare.positional_reconcile(a, a, "pos", ["name"]).where("NOT match").count() == 0
    assert checks.failures(checks.parity_checks(parity, ["name", "n"])).first().check == "parity_matches"


def test_rates_ratios_and_best_setting(spark):
    rows = spark.createDataFrame([("cpp", 40.0), ("py", 8.0)], "impl string, rate double")
    ratio = metrics.throughput_ratio(rows, "impl", "rate", "cpp", "py", [])
    assert ratio.first().ratio == 5.0
    assert checks.failures(checks.ratio_check(ratio, F.lit("r"), "ratio")).count() == 0
    wrong = ratio.withColumn("ratio", F.lit(5.1))
    assert checks.failures(checks.ratio_check(wrong, F.lit("r"), "ratio")).count() == 1
    sweep = spark.createDataFrame([(64, 2.0, 1), (16, 2.0, 0), (256, 3.0, 2)], "cap int, p50 double, i int")
    assert metrics.best_setting(sweep, "cap", "p50", "i", []).first().best_setting == 16
    one = spark.createDataFrame([("X", 5)], "symbol string, timestamp_ns bigint")
    assert metrics.event_rate(one, ["symbol"]).first().events_per_second == 0.0


def test_checks_of_a_policy_report(spark):
    good = dict(policy="none", input_events=101, accepted_signals=60, debounced_signals=20,
                signal_reduction_pct=25.0, duplicate_sequences=6, out_of_order_timestamps=5,
                stale_quotes=7, future_quotes=3, stop_triggers=1, post_crash_window_ticks=40,
                post_crash_window_valid_quotes=30, post_crash_window_accepted_signals=20,
                post_crash_window_debounced_signals=10, stop_limit_marketable_at_crash=False,
                base_tick_count=100, input_event_count=101, window_ticks=40)
    assert checks.failures(checks.policy_checks(spark.createDataFrame([good]))).count() == 0
    breaks = {
        "events_accounted": dict(stale_quotes=8),
        "input_matches_summary": dict(input_event_count=102),
        "duplicates_expected": dict(base_tick_count=98),
        "reduction_recomputes": dict(signal_reduction_pct=25.1),
        "one_stop_not_marketable": dict(stop_triggers=2),
        "window_size": dict(window_ticks=41),
        "window_accounted": dict(post_crash_window_debounced_signals=11),
    }
    for name, change in breaks.items():
        failed = checks.failures(checks.policy_checks(spark.createDataFrame([{**good, **change}])))
        assert name in {r.check for r in failed.collect()}
    three = spark.createDataFrame(
        [{**good, "policy": p, "post_crash_window_accepted_signals": n} for p, n in (("a", 9), ("b", 9), ("c", 0))])
    assert checks.failures(checks.policy_set_check(three, ["a", "b", "c"])).count() == 0
    assert checks.failures(checks.policy_set_check(three, ["a", "b"])).count() == 1
    assert checks.failures(checks.window_order_check(three, ["a", "b", "c"])).count() == 1
    assert checks.failures(checks.window_order_check(three, ["a", "c"])).count() == 0


@pytest.mark.parametrize("shape", ["id", "id * id", "0", "pmod(xxhash64(id), 7)", "if(id % 3 = 0, id, -5)"])
def test_percentiles_of_groups_larger_than_the_sketch(spark, shape):
    """Even, steep, constant, few-valued and half-constant groups, one of them hot."""
    rows = spark.range(60_000).selectExpr("if(id % 3 < 2, 'hot', concat('g', id % 30)) as g", f"{shape} as v")
    rows = rows.repartition(7)
    ranks = {"p0": 0.0, "p1": 0.01, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    data = {}
    for r in rows.collect():
        data.setdefault(r.g, []).append(r.v)
    for r in percentiles.lower_rank_percentiles(rows, ["g"], "v", ranks).collect():
        ordered = sorted(data[r.g])
        assert [r[n] for n in ranks] == [ordered[min(len(ordered) - 1, math.floor((len(ordered) - 1) * p))] for p in ranks.values()]
    everything = sorted(v for vs in data.values() for v in vs)
    whole = percentiles.lower_rank_percentiles(rows, [], "v", ranks).first()
    assert [whole[n] for n in ranks] == [everything[min(59_999, math.floor(59_999 * p))] for p in ranks.values()]


def test_percentiles_take_two_scans(spark, tmp_path):
    path = str(tmp_path / "values")
    spark.range(1000).selectExpr("id % 5 as g", "id as v").write.parquet(path)
    found = percentiles.lower_rank_percentiles(spark.read.parquet(path), ["g"], "v", {"m": 0.5, "n": 0.9})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "Python" not in plan


def test_percentiles_of_odd_doubles(spark):
    values = [math.nan, math.inf, -math.inf, None, 0.0, -0.0, 3.5]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    row = percentiles.lower_rank_percentiles(rows, [], "v", {"low": 0.0, "mid": 0.5, "high": 0.8, "top": 1.0}).first()
    assert (row.low, row.mid, row.high) == (-math.inf, 0.0, math.inf) and math.isnan(row.top)
    assert percentiles.lower_rank_percentiles(rows.limit(0), [], "v", {"m": 0.5}).first().m is None


def test_gaps_of_any_sequences(spark):
    """Negative, far apart, at bitmap ends, repeated and null sequences; a group without any."""
    rng = random.Random(4)
    data = {
        "a": [-70_000, -32_768, -32_767, -1, 0, 1, 2, 32_767, 32_768, 32_769, 32_770, 65_536, 65_537, 10**12],
        "b": list(range(100_000)),
        "c": sorted(rng.sample(range(-50_000, 50_000), 3_000)),
        "d": [5],
    }
    rows = [(g, v) for g, vs in data.items() for v in vs] + [("a", 2), ("a", None), ("e", None)]
    table = spark.createDataFrame(rows, "g string, sequence bigint").repartition(5)
    got = sorted(tuple(r) for r in audit.sequence_gaps(table, ["g"], bits=12).collect())
    assert got == sorted((g, a + 1, b - 1) for g, vs in data.items() for a, b in zip(vs, vs[1:]) if b > a + 1)
    counted = audit.audit_ticks(table.withColumns({"bid": F.lit(1.0), "ask": F.lit(2.0)}), by=["g"])
    assert {r.g: r.distinct_sequences for r in counted.collect()} == {**{g: len(vs) for g, vs in data.items()}, "e": 0}
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "distinct" not in plan.lower().replace("distinct_sequences", "")


def test_grid_of_dealt_entries_shuffles_no_cell(spark):
    """Checks of a grid meet no more rows in a shuffle than there are entries and their counts."""
    entries = spark.range(40).select(F.col("id").alias("part"), (F.col("id") + 50.0).alias("entry_price"))
    cells = grid.gap_grid(entries, keys=["part"])
    found = checks.grid_checks(cells, ["part"])
    assert found.count() == 3 * 40 and checks.failures(found).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "offset_bps" not in "".join(x for x in plan.splitlines() if "Exchange" in x)
    pages = cells.where("not (part = 3 and gap_bps = 5.0)").withColumn(
        "part", F.when(F.col("part") != 7, F.col("part"))
    )
    bad = {r.part: (r.cells, r.offsets, r.gaps) for r in grid.grid_coverage(pages, ["part"]).collect()}
    assert bad[3] == (21, 3, 7) and bad[None] == bad[5] == (24, 3, 8)
    empty = grid.grid_coverage(cells.where("false"), []).collect()
    assert [tuple(r) for r in empty] == [(0, 0, 0)]


def test_grid_partitions_follow_the_cells(spark, monkeypatch):
    monkeypatch.setattr(grid, "PARTITION_CELLS", 24)
    cells = grid.gap_grid(spark.range(40).selectExpr("id as part", "1.0D as entry_price"), keys=["part"])
    assert cells.rdd.getNumPartitions() == 40

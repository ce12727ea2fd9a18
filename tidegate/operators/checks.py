"""Consistency checks of report tables, as rows (check, subject, passed, detail).

Every check of every report row is a row of the result, so all failures show at once.
A null in a checked value counts as a failure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions import quotes as q
from tidegate.operators.compare import parity_check
from tidegate.operators.grid import boundary_check, grid_coverage


def _rows(report: DataFrame, subject: Column, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """`checks` maps a name to (condition, detail)."""
    cells = F.array(
        *[
            F.struct(
                F.lit(name).alias("check"),
                F.coalesce(condition, F.lit(False)).alias("passed"),
                detail.cast("string").alias("detail"),
            )
            for name, (condition, detail) in checks.items()
        ]
    )
    return report.select(subject.cast("string").alias("subject"), F.inline(cells)).select(
        "check", "subject", "passed", "detail"
    )


def _ordered(*values: Column) -> Column:
    ok = values[0] >= 0
    for low, high in zip(values, values[1:]):
        ok = ok & (low <= high)
    return ok


def policy_checks(report: DataFrame, subject: str = "policy") -> DataFrame:
    """Row checks of a policy report that also carries `base_tick_count`,
    `input_event_count` and `window_ticks` of its summary."""
    c = F.col
    accepted, held = c("accepted_signals"), c("debounced_signals")
    accounted = (
        accepted
        + held
        + c("duplicate_sequences")
        + c("out_of_order_timestamps")
        + c("stale_quotes")
        + c("future_quotes")
    )
    base = c("base_tick_count")
    expected_input = base + F.greatest(F.lit(0), F.floor((base - 1) / F.lit(97.0)).cast("bigint"))
    reduction = q.signal_reduction_pct(accepted, held)
    valid = c("post_crash_window_valid_quotes")
    inside = c("post_crash_window_accepted_signals") + c("post_crash_window_debounced_signals")
    return _rows(
        report,
        c(subject),
        {
            "events_accounted": (accounted == c("input_events"), accounted),
            "input_matches_summary": (c("input_events") == c("input_event_count"), c("input_events")),
            "duplicates_expected": (
                (base >= 1) & (c("input_event_count") == expected_input),
                expected_input,
            ),
            "reduction_recomputes": (
                q.within(c("signal_reduction_pct"), reduction, 1e-6),
                F.round(reduction, 6),
            ),
            "one_stop_not_marketable": (
                (c("stop_triggers") == 1) & ~c("stop_limit_marketable_at_crash"),
                c("stop_triggers"),
            ),
            "window_size": (c("post_crash_window_ticks") == c("window_ticks"), c("window_ticks")),
            "window_accounted": (
                (valid == inside) & (valid <= c("post_crash_window_ticks")),
                inside,
            ),
        },
    )


def timing_checks(report: DataFrame, subject: str, rate: str, quantiles: list[str]) -> DataFrame:
    """Positive rate, quantiles ascending from zero."""
    return _rows(
        report,
        F.col(subject),
        {
            "rate_positive": (F.col(rate) > 0, F.lit(rate)),
            "quantiles_ordered": (_ordered(*map(F.col, quantiles)), F.lit(",".join(quantiles))),
        },
    )


def policy_set_check(report: DataFrame, expected: list[str], by: list[str] | None = None) -> DataFrame:
    """The report holds exactly the expected policies."""
    by = by or []
    found = report.groupBy(*by).agg(F.array_sort(F.collect_set("policy")).alias("found"))
    wanted = F.array(*map(F.lit, sorted(expected)))
    subject = F.concat_ws("/", *by) if by else F.lit("report")
    return _rows(
        found,
        subject,
        {"policy_names": (F.col("found") == wanted, F.concat_ws(",", "found"))},
    )


def window_order_check(report: DataFrame, falling: list[str], by: list[str] | None = None) -> DataFrame:
    """Accepted signals in the window fall strictly along the listed policies."""
    by = by or []
    value = F.col("post_crash_window_accepted_signals")
    counts = report.groupBy(*by).agg(
        F.max("window_ticks").alias("window_ticks"),
        *[F.max(F.when(F.col("policy") == p, value)).alias(f"_p{i}") for i, p in enumerate(falling)],
    )
    ok = F.lit(True)
    for i in range(len(falling) - 1):
        ok = ok & (F.col(f"_p{i}") > F.col(f"_p{i + 1}"))
    subject = F.concat_ws("/", *by) if by else F.lit("report")
    detail = F.concat_ws(">", *[F.col(f"_p{i}").cast("string") for i in range(len(falling))])
    return _rows(
        counts,
        subject,
        {"window_acceptance_falls": ((F.col("window_ticks") == 0) | ok, detail)},
    )


def same_report_check(
    flat: DataFrame, nested: DataFrame, position: str, columns: list[str]
) -> DataFrame:
    """A flat report agrees with a nested one, row by row in the same order."""
    parity = parity_check(flat, nested, [position], columns)
    return _rows(
        parity,
        F.concat_ws(".", F.col(position).cast("string"), F.col("check")),
        {"csv_agrees_with_json": (F.col("match"), F.concat_ws(" / ", "left_value", "right_value"))},
    )


def grid_checks(grid: DataFrame, keys: list[str], offsets: int = 3, gaps: int = 8) -> DataFrame:
    coverage = grid_coverage(grid, keys)
    subject = F.concat_ws("/", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("grid")
    size = _rows(
        coverage,
        subject,
        {
            "grid_size": (
                (F.col("cells") == offsets * gaps)
                & (F.col("offsets") == offsets)
                & (F.col("gaps") == gaps),
                F.col("cells"),
            )
        },
    )
    cells = boundary_check(grid, keys).groupBy(*keys).agg(
        F.count_if(~F.col("flag_ok")).alias("wrong"),
        F.count_if("returns_true").alias("returning"),
    )
    flags = _rows(
        cells,
        subject,
        {
            "grid_flags_recompute": (F.col("wrong") == 0, F.col("wrong")),
            "grid_boundary_monotone": (F.col("returning") == 0, F.col("returning")),
        },
    )
    return size.unionByName(flags)


def pipeline_checks(report: DataFrame, subject: str) -> DataFrame:
    """Raw pipeline: warm-up rule, measured counts, samples, no invalid quotes."""
    c = F.col
    ticks, warmup = c("ticks"), c("warmup_ticks")
    rule = F.least(F.floor(ticks / F.lit(10.0)).cast("bigint"), F.lit(10_000))
    return _rows(
        report,
        c(subject),
        {
            "measured_count": (c("measured_ticks") == ticks - warmup, c("measured_ticks")),
            "warmup_rule": ((ticks >= 1) & (warmup == rule), warmup),
            "has_samples": (c("latency_sample_count") >= 1, c("latency_sample_count")),
            "no_invalid": (c("invalid_ticks") == 0, c("invalid_ticks")),
            "signals_cover_ticks": (
                c("signals_accepted") + c("signals_debounced") == ticks,
                c("signals_accepted") + c("signals_debounced"),
            ),
        },
    )


def message_checks(report: DataFrame, subject: Column, target_us: float = 10.0) -> DataFrame:
    c = F.col
    quantiles = [f"{p}_one_way_us" for p in ("p50", "p95", "p99", "max")]
    return _rows(
        report,
        subject,
        {
            "samples_match": (
                (c("measured_messages") >= 1)
                & (c("timed_sample_count") == c("measured_messages")),
                c("timed_sample_count"),
            ),
            "payload_passed": (c("payload_check") == "passed", c("payload_check")),
            "no_bad_sequences": (c("bad_sequences") == 0, c("bad_sequences")),
            "no_invalid_timestamps": (c("invalid_timestamps") == 0, c("invalid_timestamps")),
            "quantiles_ordered": (_ordered(*map(c, quantiles)), F.lit(",".join(quantiles))),
            "rate_positive": (c("throughput_messages_per_second") > 0, F.lit("rate")),
            "target_flag_agrees": (
                c("sub_10_us_p50") == q.meets_target(c("p50_one_way_us"), target_us),
                c("sub_10_us_p50"),
            ),
        },
    )


def capacity_check(report: DataFrame, capacity: str) -> DataFrame:
    """Queue capacity is a power of two from 2 to 4096."""
    size = F.col(capacity)
    fits = (size >= 2) & (size <= 4096) & (size.bitwiseAND(size - 1) == 0)
    return _rows(report, size, {"capacity_power_of_two": (fits, size)})


def sweep_checks(
    results: DataFrame, setting: str, expected: list[int], counts: list[str], p50: str,
    best: Column, by: list[str] | None = None,
) -> DataFrame:
    """Settings cover the expected set, counts agree, the named best has the lowest p50."""
    by = by or []
    rows = results.groupBy(*by).agg(
        F.array_sort(F.collect_set(setting)).alias("_settings"),
        F.count("*").alias("_rows"),
        F.min_by(setting, F.struct(p50, setting)).alias("_best"),
        F.max(best).alias("_named"),
        *[F.min(c).eqNullSafe(F.max(c)).alias(f"_same_{c}") for c in counts],
    )
    same = F.lit(True)
    for c in counts:
        same = same & F.col(f"_same_{c}")
    wanted = F.array(*[F.lit(e) for e in sorted(expected)]).cast(rows.schema["_settings"].dataType)
    subject = F.concat_ws("/", *by) if by else F.lit("sweep")
    return _rows(
        rows,
        subject,
        {
            "settings_covered": (
                (F.col("_settings") == wanted) & (F.col("_rows") == len(expected)),
                F.col("_rows"),
            ),
            "counts_agree": (same, F.lit(",".join(counts))),
            "best_is_lowest_p50": (F.col("_named") == F.col("_best"), F.col("_best")),
        },
    )


def storage_checks(report: DataFrame, subject: Column, minimum_rows: int = 1) -> DataFrame:
    c = F.col
    n = c("rows_requested")
    equal = (
        (c("rows_written") == n) & (c("rows_read_back") == n) & (c("distinct_sequences") == n)
    )
    return _rows(
        report,
        subject,
        {
            "minimum_rows": (n >= minimum_rows, n),
            "counts_equal": ((n >= 1) & equal, c("rows_read_back")),
            "range_complete": (
                (c("first_sequence") == 0) & (c("last_sequence") == n - 1),
                c("last_sequence"),
            ),
            "no_bad_quotes": (c("bad_quotes") == 0, c("bad_quotes")),
        },
    )


def parity_checks(parity: DataFrame, required: list[str], by: list[str] | None = None) -> DataFrame:
    """The parity table covers exactly the required keys and every one matches."""
    by = by or []
    rows = parity.groupBy(*by).agg(
        F.array_sort(F.collect_set("check")).alias("_keys"),
        F.count_if(~F.col("match")).alias("_bad"),
    )
    wanted = F.array(*map(F.lit, sorted(required)))
    subject = F.concat_ws("/", *by) if by else F.lit("parity")
    return _rows(
        rows,
        subject,
        {
            "parity_keys": (F.col("_keys") == wanted, F.concat_ws(",", "_keys")),
            "parity_matches": (F.col("_bad") == 0, F.col("_bad")),
        },
    )


def ratio_check(ratios: DataFrame, subject: Column, stated: str) -> DataFrame:
    """A stated ratio equals the ratio of its two rates within 1e-6 relative."""
    expected = F.col("numerator_rate") / F.when(F.col("denominator_rate") > 0, F.col("denominator_rate"))
    tolerance = F.greatest(F.lit(1e-6), expected * F.lit(1e-6))
    ok = (F.col(stated) > 0) & (F.abs(F.col(stated) - expected) <= tolerance)
    return _rows(ratios, subject, {"ratio_recomputes": (ok, F.round(expected, 6))})


def finite_checks(report: DataFrame, subject: Column, columns: list[str]) -> DataFrame:
    return _rows(
        report,
        subject,
        {f"finite_{c}": (q.is_finite(F.col(c).cast("double")), F.col(c)) for c in columns},
    )


def failures(checks: DataFrame) -> DataFrame:
    return checks.where(~F.col("passed"))

"""Report checks on reports with real faults: every k-th row is wrong in one way or another.

The reports come from whole tables; the SQL states what each check must answer from the
report's own numbers, so a check that always answers the same fails.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.operators import audit, checks, compare, metrics
from tidegate.plans import catalog
from tidegate.plans import events_view as ev
from tidegate.plans.catalog import query
from tidegate.session import new_path
from tidegate.sources import reports
from tidegate.sources.ticks import append_ticks, scan_ticks

POLICY_NAMES = ["none", "fixed", "dynamic"]
WINDOW = 12

# Counters of a policy report per supplier and policy, out of the order lines.
_COUNTERS = {
    "accepted_signals": "l_quantity < 30",
    "debounced_signals": "l_quantity >= 30",
    "duplicate_sequences": "l_returnflag = 'A'",
    "out_of_order_timestamps": "l_returnflag = 'R'",
    "stale_quotes": "l_linestatus = 'F'",
    "future_quotes": "l_linestatus = 'O'",
    "stop_triggers": "l_tax > 0.07 AND l_discount > 0.08",
    "post_crash_window_accepted_signals": "l_quantity < 4 AND l_linenumber < 5",
    "post_crash_window_debounced_signals": "l_quantity > 48",
}
_SUM = " + ".join(list(_COUNTERS)[:6])
_INSIDE = " + ".join(list(_COUNTERS)[7:])

# What is wrong where: `run` is the supplier.  Spark and DuckDB read the same expressions.
_STATED = {
    "input_events": f"{_SUM} + CASE WHEN run % 7 = 0 THEN 1 ELSE 0 END",
    "post_crash_window_valid_quotes": f"{_INSIDE} + CASE WHEN run % 5 = 0 THEN 1 ELSE 0 END",
    "post_crash_window_ticks": f"CASE WHEN run % 6 = 0 THEN {WINDOW} - 1 ELSE {WINDOW} END",
    "stop_limit_marketable_at_crash": "run % 4 = 0",
    "signal_reduction_pct": "100.0 * debounced_signals / (accepted_signals + debounced_signals)"
    " + CASE WHEN run % 3 = 0 THEN 0.001 ELSE 0.0 END",
    "base_tick_count": "(98 * run + 50)",
}
_SUMMARY = {
    "input_event_count": "CASE WHEN run % 2 = 0 THEN base_tick_count + (base_tick_count - 1) DIV 97 ELSE input_events END",
}

_REPORT_SQL = f"""
    (SELECT *, {_SUMMARY['input_event_count'].replace('DIV', '//')} AS input_event_count
     FROM (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _STATED.items())}
           FROM (SELECT l_suppkey AS run, ['none', 'fixed', 'dynamic'][l_linenumber % 3 + 1] AS policy,
                        {', '.join(f'count(*) FILTER ({e}) AS {n}' for n, e in _COUNTERS.items())}
                 FROM lineitem GROUP BY ALL)
           WHERE NOT (run % 9 = 0 AND policy = 'fixed')))"""


def faulty_report(spark, sf) -> DataFrame:
    """A policy report per supplier; the fixed policy is missing for every ninth."""
    policy = F.element_at(F.array(*map(F.lit, POLICY_NAMES)), (F.col("l_linenumber") % 3 + 1).cast("int"))
    lines = ev.table(spark, sf, "lineitem").withColumns({"run": F.col("l_suppkey"), "policy": policy})
    counts = lines.groupBy("run", "policy").agg(*[F.expr(f"count_if({e})").alias(n) for n, e in _COUNTERS.items()])
    counts = counts.where("not (run % 9 = 0 and policy = 'fixed')")
    stated = counts.select("*", *[F.expr(e).cast(_type(n)).alias(n) for n, e in _STATED.items()])
    stated = stated.select("*", *[F.expr(e).cast("bigint").alias(n) for n, e in _SUMMARY.items()])
    return stated.withColumns(
        {"window_ticks": F.lit(WINDOW).cast("bigint"), "subject": F.concat_ws("/", "run", "policy")}
    )


def _type(name: str) -> str:
    return {"signal_reduction_pct": "double", "stop_limit_marketable_at_crash": "boolean"}.get(name, "bigint")


_POLICY_CHECKS = {
    "events_accounted": f"{_SUM} = input_events",
    "input_matches_summary": "input_events = input_event_count",
    "duplicates_expected": "input_event_count = base_tick_count + (base_tick_count - 1) // 97",
    "reduction_recomputes": "abs(signal_reduction_pct - 100.0::DOUBLE * debounced_signals"
    " / (accepted_signals + debounced_signals)) <= 1e-6",
    "one_stop_not_marketable": "stop_triggers = 1 AND run % 4 <> 0",
    "window_size": f"post_crash_window_ticks = {WINDOW}",
    "window_accounted": f"post_crash_window_valid_quotes = {_INSIDE}"
    " AND post_crash_window_valid_quotes <= post_crash_window_ticks",
}


@query(
    "faulty_policy_checks",
    f"""SELECT unnest([{', '.join(f"'{n}'" for n in _POLICY_CHECKS)}]) AS "check",
               run || '/' || policy AS subject,
               unnest([{', '.join(_POLICY_CHECKS.values())}]) AS passed FROM {_REPORT_SQL}""",
)
def faulty_policy_checks(spark, sf):
    return checks.policy_checks(faulty_report(spark, sf), "subject").select("check", "subject", "passed")


@query(
    "faulty_policy_sets",
    f"""SELECT 'policy_names' AS "check", run::VARCHAR AS subject,
               list_sort(list(policy)) = ['dynamic', 'fixed', 'none'] AS passed FROM {_REPORT_SQL} GROUP BY run
        UNION ALL
        SELECT 'window_acceptance_falls', run::VARCHAR, coalesce(
               max(post_crash_window_accepted_signals) FILTER (policy = 'none')
               > max(post_crash_window_accepted_signals) FILTER (policy = 'fixed')
               AND max(post_crash_window_accepted_signals) FILTER (policy = 'fixed')
               > max(post_crash_window_accepted_signals) FILTER (policy = 'dynamic'), FALSE)
        FROM {_REPORT_SQL} GROUP BY run""",
)
def faulty_policy_sets(spark, sf):
    report = faulty_report(spark, sf)
    names = checks.policy_set_check(report, POLICY_NAMES, ["run"])
    falling = checks.window_order_check(report, POLICY_NAMES, ["run"])
    return names.unionByName(falling).select("check", "subject", "passed")


_ITEMS = """(SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS position FROM part)"""


@query(
    "faulty_csv_json",
    f"""SELECT 'csv_agrees_with_json' AS "check", p_brand || ':' || position || '.' || c AS subject,
               CASE c WHEN 'p_partkey' THEN TRUE WHEN 'p_size' THEN position % 10 <> 3 ELSE position % 4 <> 1 END
               AND position % 13 <> 5 AS passed
        FROM {_ITEMS} CROSS JOIN (VALUES ('p_partkey'), ('p_size'), ('cents')) t(c)""",
)
def faulty_csv_json(spark, sf):
    """Nested JSON, a document per brand, and a CSV with other values and rows lost."""
    cents = F.round(F.col("p_retailprice") * 100).cast("bigint")
    parts = ev.table(spark, sf, "part").select("p_brand", "p_partkey", "p_size", cents.alias("cents"))
    documents = reports.nest(parts, "rows", ["p_partkey"], ["p_brand"])
    json_path, csv_path = new_path(spark, "json"), new_path(spark, "csv")
    reports.write_report(documents, json_path, "json")
    back = reports.read_json_report(spark, json_path, documents.schema)[0]
    nested = back.select("p_brand", F.posexplode("rows").alias("position", "row")).select("p_brand", "position", "row.*")
    nested = nested.withColumn("place", F.concat_ws(":", "p_brand", "position"))
    position = F.col("position")
    size = F.when(position % 10 == 3, F.col("p_size") + 1).otherwise(F.col("p_size"))
    flat = nested.where(position % 13 != 5).withColumns(
        {
            "p_size": size.cast(parts.schema["p_size"].dataType),
            "cents": F.when(position % 4 == 1, F.lit(None).cast("bigint")).otherwise(F.col("cents")),
        }
    )
    columns = ["place", "p_partkey", "p_size", "cents"]
    reports.write_report(flat, csv_path, "csv", columns)
    again = reports.read_csv_report(spark, csv_path, nested.select(columns).schema)
    return checks.same_report_check(again, nested, "place", columns[1:]).select("check", "subject", "passed")


_CELLS = """
    (SELECT p_partkey, offset_bps, gap_bps,
            (observed_price >= limit_price - 1e-10) AS expected,
            marketable <> (p_partkey % 6 = 0 AND gap_bps = 5.0) AS marketable
     FROM (SELECT p_partkey, offset_bps, gap_bps, limit_price, observed_price, observed_price >= limit_price AS marketable
           FROM (SELECT p_partkey, offset_bps, gap_bps, limit_price,
                        observed_price * CASE WHEN p_partkey % 8 = 0 AND gap_bps = 50.0 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END
                            AS observed_price FROM {grid}))
     WHERE NOT (p_partkey % 5 = 0 AND gap_bps = 1.0 AND offset_bps = 5.0))""".format(grid=catalog._GRID)


@query(
    "faulty_grid_checks",
    f"""SELECT 'grid_size' AS "check", p_partkey::VARCHAR AS subject, count(*) = 24 AS passed FROM {_CELLS} GROUP BY p_partkey
        UNION ALL SELECT 'grid_flags_recompute', p_partkey::VARCHAR, bool_and(marketable = expected) FROM {_CELLS} GROUP BY p_partkey
        UNION ALL SELECT 'grid_boundary_monotone', p_partkey::VARCHAR, NOT bool_or(expected AND lost)
        FROM (SELECT *, coalesce(bool_or(NOT expected) OVER (PARTITION BY p_partkey, offset_bps ORDER BY gap_bps
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS lost FROM {_CELLS})
        GROUP BY p_partkey""",
)
def faulty_grid_checks(spark, sf):
    """Grids with a cell lost, a flag turned round, or a price that comes back."""
    key, gap = F.col("p_partkey"), F.col("gap_bps")
    back = F.when((key % 8 == 0) & (gap == 50.0), F.lit(1.1)).otherwise(F.lit(1.0))
    cells = catalog.part_grid(spark, sf).withColumn("observed_price", F.col("observed_price") * back)
    cells = cells.withColumn("marketable", F.col("observed_price") >= F.col("limit_price"))
    cells = cells.withColumn("marketable", F.col("marketable") != ((key % 6 == 0) & (gap == 5.0)))
    cells = cells.where(~((key % 5 == 0) & (gap == 1.0) & (F.col("offset_bps") == 5.0)))
    return checks.grid_checks(cells, ["p_partkey"]).select("check", "subject", "passed")


_SENT = "(SELECT (l_suppkey % 40)::VARCHAR AS symbol, row_number() OVER (PARTITION BY l_suppkey % 40 ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS sequence FROM lineitem)"


@query(
    "faulty_storage_checks",
    f"""SELECT unnest(['minimum_rows', 'counts_equal', 'range_complete', 'no_bad_quotes']) AS "check", symbol AS subject,
               unnest([sent >= 1, read = sent AND kinds = sent, low = 0 AND high = sent - 1, bad = 0]) AS passed
        FROM (SELECT symbol, count(*) FILTER (copy = 0) AS sent, count(*) FILTER (kept) AS read,
                     count(DISTINCT sequence) FILTER (kept) AS kinds, min(sequence) FILTER (kept) AS low,
                     max(sequence) FILTER (kept) AS high,
                     count(*) FILTER (kept AND symbol::INT % 11 = 4 AND sequence = 7) AS bad
              FROM (SELECT *, NOT (symbol::INT % 7 = 1 AND sequence = 3) AND NOT (symbol::INT % 10 = 6 AND sequence = 0) AS kept
                    FROM (SELECT *, 0 AS copy FROM {_SENT}
                          UNION ALL SELECT *, 1 AS copy FROM {_SENT} WHERE symbol::INT % 9 = 2 AND sequence = 5))
              GROUP BY symbol)""",
)
def faulty_storage_checks(spark, sf):
    """Streams stored with rows lost, repeated, or with crossed prices, against what was sent."""
    lines = ev.table(spark, sf, "lineitem").withColumn("symbol", (F.col("l_suppkey") % 40).cast("string"))
    number = "row_number() over (partition by symbol order by l_orderkey, l_linenumber, l_partkey) - 1"
    sent = lines.select("symbol", F.expr(number).cast("bigint").alias("sequence"))
    symbol, sequence = F.col("symbol").cast("int"), F.col("sequence")
    lost = ((symbol % 7 == 1) & (sequence == 3)) | ((symbol % 10 == 6) & (sequence == 0))
    twice = F.when((symbol % 9 == 2) & (sequence == 5), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    crossed = (symbol % 11 == 4) & (sequence == 7)
    rows = sent.where(~lost).select("*", F.explode(twice).alias("copy"))
    stored = rows.withColumns(
        {
            "timestamp_ns": sequence * 1000,
            "bid": F.when(crossed, 2.0).otherwise(F.lit(1.0)),
            "ask": F.lit(1.5),
        }
    )
    path = new_path(spark, "stored")
    append_ticks(stored, path)
    requested = sent.groupBy("symbol").agg(F.count("*").alias("sent"))
    report = audit.audit_ticks(scan_ticks(spark, path), by=["symbol"]).join(requested, "symbol", "right")
    report = report.withColumns({"rows_requested": F.col("sent"), "rows_written": F.col("rows_read_back")})
    return checks.storage_checks(report, F.col("symbol")).select("check", "subject", "passed")


_RATES = """(SELECT l_suppkey AS run, count(*) FILTER (l_quantity < 30)::DOUBLE AS a,
                    count(*) FILTER (l_quantity >= 45)::DOUBLE AS b FROM lineitem GROUP BY 1)"""


@query(
    "faulty_ratio_checks",
    f"""SELECT 'ratio_recomputes' AS "check", run::VARCHAR AS subject,
               coalesce(b > 0 AND a > 0 AND run % 5 <> 2, FALSE) AS passed FROM {_RATES}""",
)
def faulty_ratio_checks(spark, sf):
    """Stated ratios, every fifth of which is off by a hundredth."""
    lines = ev.table(spark, sf, "lineitem").withColumn("run", F.col("l_suppkey"))
    rates = lines.groupBy("run").agg(
        F.count_if(F.col("l_quantity") < 30).cast("double").alias("fast"),
        F.count_if(F.col("l_quantity") >= 45).cast("double").alias("slow"),
    )
    long = rates.unpivot(["run"], ["fast", "slow"], "side", "rate")
    both = metrics.throughput_ratio(long, "side", "rate", "fast", "slow", ["run"])
    off = F.when(F.col("run") % 5 == 2, F.lit(1.01)).otherwise(F.lit(1.0))
    return checks.ratio_check(both.withColumn("stated", F.col("ratio") * off), F.col("run"), "stated").select(
        "check", "subject", "passed"
    )


@query(
    "faulty_parity_checks",
    """SELECT 'parity_keys' AS "check", run::VARCHAR AS subject, run % 6 <> 5 AS passed FROM
       (SELECT DISTINCT l_suppkey AS run FROM lineitem)
       UNION ALL SELECT 'parity_matches', run::VARCHAR, run % 4 <> 3 FROM (SELECT DISTINCT l_suppkey AS run FROM lineitem)""",
)
def faulty_parity_checks(spark, sf):
    """Two result sets: a counter off for every fourth, a counter missing for every sixth."""
    counts = ev.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("run")).agg(
        F.count("*").alias("lines"), F.min("l_orderkey").alias("first"), F.max("l_orderkey").alias("last")
    )
    other = counts.withColumn("last", F.when(F.col("run") % 4 == 3, F.col("last") + 1).otherwise(F.col("last")))
    parity = compare.parity_check(counts, other, ["run"], ["lines", "first", "last"])
    parity = parity.where("not (run % 6 = 5 and check = 'first')")
    return checks.parity_checks(parity, ["first", "last", "lines"], ["run"]).select("check", "subject", "passed")

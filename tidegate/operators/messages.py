"""Latency and integrity of a message log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.functions import quotes as q
from tidegate.operators.percentiles import lower_rank_percentiles
from tidegate.operators.scan import AUTO, Arranged, Running, arrange, running

_PROBABILITIES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


def sequence_continuity(
    messages: DataFrame,
    keys: list[str],
    order: str = "arrival",
    bits: int | str = AUTO,
) -> DataFrame:
    """Add the expected sequence and flags for wrong sequences and impossible times."""
    stream = arrange(messages, bits, (order,), tuple(keys))
    one = {"expected_sequence": Running("sum", F.lit(1).cast("bigint"))}
    rows = Arranged(running(stream.rows, stream.layout, one), stream.layout).df
    sent, received = F.col("sent_ns"), F.col("received_ns")
    expected = F.coalesce(F.col("expected_sequence"), F.lit(0).cast("bigint"))
    return rows.withColumns(
        {
            "expected_sequence": expected,
            "bad_sequence": ~F.col("sequence").eqNullSafe(expected),
            "invalid_timestamp": ~F.coalesce((sent > 0) & (received >= sent), F.lit(False)),
        }
    )


def payload_check(requests: DataFrame, replies: DataFrame, keys: list[str]) -> DataFrame:
    """Per message key: requests, replies and status ok, mismatch, missing_reply or
    unexpected_reply.

    Equal texts are counted on both sides instead of joined, so a key that was sent many
    times costs no pairs.
    """
    sent = requests.select(*keys, F.col("payload").alias("_text"), F.lit(1).alias("_sent"))
    back = replies.select(*keys, F.col("reply").alias("_text"), F.lit(0).alias("_sent"))
    texts = sent.unionByName(back).groupBy(*keys, "_text").agg(
        F.sum("_sent").alias("sent"), (F.count("*") - F.sum("_sent")).alias("replies")
    )
    totals = texts.groupBy(*keys).agg(
        F.sum("sent").alias("sent"),
        F.sum("replies").alias("replies"),
        F.every(F.col("sent") == F.col("replies")).alias("_same"),
    )
    status = (
        F.when(F.col("_same"), "ok")
        .when(F.col("replies") == 0, "missing_reply")
        .when(F.col("sent") == 0, "unexpected_reply")
        .otherwise("mismatch")
    )
    return totals.select(*keys, "sent", "replies", status.alias("status"))


def message_report(
    messages: DataFrame,
    keys: list[str],
    warmup: int = 0,
    target_us: float = 10.0,
    bits: int | str = AUTO,
) -> DataFrame:
    """One row per channel: samples, one-way and round-trip latency, rate and faults.

    The first `warmup` messages of a channel take part in the integrity checks but not
    in the timings.
    """
    rows = sequence_continuity(messages, keys, bits=bits)
    measured = F.col("expected_sequence") >= warmup
    timed = measured & ~F.col("invalid_timestamp")
    one_way = F.when(timed, F.col("received_ns") - F.col("sent_ns"))
    round_trip = F.when(timed, F.col("acked_ns") - F.col("sent_ns"))
    received = F.when(timed, F.col("received_ns"))
    rows = rows.withColumns({"_one_way": one_way, "_round_trip": round_trip})
    mean = lambda c: F.coalesce(F.sum(c) / F.count(c) / F.lit(1000.0), F.lit(0.0))
    top = lambda c: F.coalesce(F.max(c) / F.lit(1000.0), F.lit(0.0))
    totals = rows.groupBy(*keys).agg(
        F.count_if(measured).alias("measured_messages"),
        F.count("_one_way").alias("timed_sample_count"),
        mean("_one_way").alias("mean_one_way_us"),
        top("_one_way").alias("max_one_way_us"),
        mean("_round_trip").alias("mean_round_trip_us"),
        top("_round_trip").alias("max_round_trip_us"),
        q.rate_per_second(F.count(received), F.min(received), F.max(received)).alias(
            "throughput_messages_per_second"
        ),
        F.count_if("bad_sequence").alias("bad_sequences"),
        F.count_if("invalid_timestamp").alias("invalid_timestamps"),
        F.count_if(~F.col("payload").eqNullSafe(F.col("reply"))).alias("bad_payloads"),
    )
    # Both latencies go through one rank selection, so the log is read and numbered once.
    values = {"one_way": F.col("_one_way"), "round_trip": F.col("_round_trip")}
    pairs = [F.struct(F.lit(m).alias("_metric"), v.alias("_ns")) for m, v in values.items()]
    ranks = lower_rank_percentiles(
        rows.select(*keys, F.inline(F.array(*pairs))), [*keys, "_metric"], "_ns", _PROBABILITIES
    )
    wide = {
        f"{p}_{m}_us": F.max(F.when(F.col("_metric") == m, F.col(p) / F.lit(1000.0)))
        for m in values
        for p in _PROBABILITIES
    }
    ranks = ranks.groupBy(*keys).agg(*[c.alias(n) for n, c in wide.items()])
    out = totals.join(ranks, keys, "left").fillna(0.0, list(wide))
    passed = (F.col("bad_payloads") == 0) & (F.col("bad_sequences") == 0)
    return out.withColumns(
        {
            "payload_check": F.when(passed, "passed").otherwise("failed"),
            "sub_10_us_p50": q.meets_target(F.col("p50_one_way_us"), target_us),
        }
    )

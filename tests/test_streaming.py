import pytest
from pyspark.sql import functions as F

import model
from test_process import POLICIES, random_stream
from tidegate.schema import ARRIVAL_SCHEMA, ORDER_SCHEMA, TICK_COLUMNS
from tidegate.operators.compare import same_rows
from tidegate.operators.process import process
from tidegate.plans import experiment
from tidegate.sources import frames, replay
from tidegate.streaming.demo import LEAST_SLICES, replay_as_stream
from tidegate.session import new_path
from tidegate.streaming import process as streaming_process
from tidegate.streaming.handover import state_after
from tidegate.streaming.process import process_stream
from tidegate.streaming.sinks import append_stream, count_reasons, reason_totals, write_stream


def flat(rows):
    """Outcomes in the form of the model's."""
    return {
        r.arrival: (
            r.accepted_signal,
            r.reason,
            r.risk_event and (r.risk_event.kind, r.risk_event.trigger_price, r.risk_event.limit_price),
        )
        for r in rows.collect()
    }


@pytest.mark.parametrize("policy", [POLICIES[0], POLICIES[3]], ids=lambda p: p.name)
def test_stream_equals_plain_loop(spark, policy):
    ticks, orders = random_stream(5)
    # The demo hands all registrations to the first trigger, so they must come first there.
    first = {}
    for o in orders:
        first.setdefault(o["symbol"], {**o, "registered_arrival": 0})
    orders = list(first.values())
    path = replay_as_stream(
        spark.createDataFrame(ticks, ARRIVAL_SCHEMA),
        spark.createDataFrame(orders, ORDER_SCHEMA),
        policy,
        100,
        20,
    )
    assert flat(spark.read.parquet(path)) == model.run(ticks, orders, policy, 100, 20)


def test_stream_equals_batch_on_real_times(spark):
    """Nanoseconds since 1970, some receive times unknown, an order in many small triggers."""
    ticks = replay.inject_faults(replay.replay_ticks(spark, 3000))
    unknown = F.when(F.col("arrival") % 7 != 0, F.col("receive_ns"))
    ticks = ticks.withColumn("receive_ns", unknown).select(*ARRIVAL_SCHEMA.names)
    orders, policy = experiment.replay_orders(spark), POLICIES[1]
    path = replay_as_stream(ticks, orders, policy, 5_000_000, 1_000_000, slices=20)
    columns = ["arrival", "timestamp_ns", "receive_ns", "reason", "accepted_signal", "risk_event"]
    streamed = spark.read.parquet(path).select(*columns)
    batch = process(ticks, orders, policy, 5_000_000, 1_000_000).select(*columns)
    assert streamed.where("timestamp_ns > 1e18").count() == batch.count() > 3000
    assert same_rows(streamed, batch).count() == 0


@pytest.mark.parametrize("policy", [POLICIES[0], POLICIES[3]], ids=lambda p: p.name)
def test_large_trigger_is_put_in_order_through_the_state_store(spark, policy, monkeypatch):
    """One trigger whose rows come in several batches, in no order at all."""
    monkeypatch.setattr(streaming_process, "PARKED_BITS", 9)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 400)
    try:
        ticks, orders = random_stream(8)
        rows = spark.createDataFrame(ticks, ARRIVAL_SCHEMA).orderBy(F.xxhash64("arrival"))
        marks = spark.createDataFrame(orders, ORDER_SCHEMA)
        path = replay_as_stream(rows, marks, policy, 100, 20, slices=1)
        found = flat(spark.read.parquet(path))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == model.run(ticks, orders, policy, 100, 20)


@pytest.mark.parametrize("with_orders", [True, False])
@pytest.mark.parametrize("policy", [POLICIES[0], POLICIES[3]], ids=lambda p: p.name)
def test_stream_goes_on_from_a_batch_run(spark, policy, with_orders):
    ticks, orders = random_stream(9)
    orders = orders if with_orders else []
    middle = len(ticks) // 2
    early = [t for t in ticks if t["arrival"] < middle], [o for o in orders if o["registered_arrival"] < middle]
    late = [t for t in ticks if t["arrival"] >= middle], [o for o in orders if o["registered_arrival"] >= middle]
    frames_of = lambda some: (
        spark.createDataFrame(some[0], ARRIVAL_SCHEMA), spark.createDataFrame(some[1], ORDER_SCHEMA)
    )
    first, second = frames_of(early), frames_of(late)
    state = state_after(first[0], first[1] if with_orders else None, policy, 100, 20)
    path = replay_as_stream(*second, policy, 100, 20, start_state=state)
    expected = model.run(ticks, orders, policy, 100, 20)
    assert flat(spark.read.parquet(path)) == {k: v for k, v in expected.items() if k >= middle}


def test_idle_symbols_are_forgotten(spark):
    """With a short idle time, each restart meets symbols it knows nothing of."""
    row = dict(symbol="X", bid=99.0, ask=101.0, receive_ns=None)
    ticks = [row | dict(sequence=5, timestamp_ns=100, arrival=0), row | dict(sequence=1, timestamp_ns=10, arrival=1)]
    reasons = {}
    for idle in (None, 1):
        paths = [new_path(spark, n) for n in ("in", "out", "state")]
        for tick in ticks:
            spark.createDataFrame([tick], ARRIVAL_SCHEMA).write.mode("append").parquet(paths[0])
            live = spark.readStream.schema(ARRIVAL_SCHEMA).parquet(paths[0])
            results = process_stream(live, None, POLICIES[0], 100, 20, idle_ms=idle)
            writer = results.writeStream.format("parquet").option("checkpointLocation", paths[2])
            writer.option("path", paths[1]).trigger(once=True).start().awaitTermination(60)
        reasons[idle] = [r.reason for r in spark.read.parquet(paths[1]).orderBy("arrival").collect()]
    assert reasons == {None: ["accepted", "duplicate_sequence"], 1: ["accepted", "accepted"]}


def test_orders_registered_while_running(spark, tmp_path):
    ticks, orders = random_stream(6)
    paths = [str(tmp_path / n) for n in ("ticks", "orders", "out", "state")]
    step = 800
    for start in range(0, 2400, step):
        part = [t for t in ticks if start <= t["arrival"] < start + step]
        registered = [o for o in orders if start <= o["registered_arrival"] < start + step]
        spark.createDataFrame(part, ARRIVAL_SCHEMA).write.mode("append").parquet(paths[0])
        spark.createDataFrame(registered, ORDER_SCHEMA).write.mode("append").parquet(paths[1])
        results = process_stream(
            spark.readStream.schema(ARRIVAL_SCHEMA).parquet(paths[0]),
            spark.readStream.schema(ORDER_SCHEMA).parquet(paths[1]),
            POLICIES[3],
            100,
            20,
        )
        count_reasons(results, paths[2], paths[3]).awaitTermination()
    expected = {}
    for arrival, (_, reason, _) in model.run(ticks, orders, POLICIES[3], 100, 20).items():
        key = (ticks[arrival]["symbol"], reason)
        expected[key] = expected.get(key, 0) + 1
    totals = reason_totals(spark, paths[2]).collect()
    assert {(r.symbol, r.reason): r.quotes for r in totals} == expected


def test_append_stream_writes_each_tick_once(spark, tmp_path):
    source, table, state = (str(tmp_path / n) for n in ("frames", "table", "state"))
    ticks = spark.range(50).select(
        F.lit("X").alias("symbol"),
        F.col("id").alias("sequence"),
        F.col("id").alias("timestamp_ns"),
        F.lit(99.0).alias("bid"),
        F.lit(101.0).alias("ask"),
    )
    for part in (ticks.where("sequence < 20"), ticks.where("sequence >= 20")):
        frames.write_tick_frames(part, source, mode="append")
        live = frames.stream_tick_frames(spark, source, max_files=2)[0]
        append_stream(live, table, state).awaitTermination()
    stored = spark.read.parquet(table)
    assert stored.columns == TICK_COLUMNS
    assert sorted(r.sequence for r in stored.collect()) == list(range(50))


def test_runs_follow_the_quotes_not_the_arrival_numbers(spark):
    """Sparse arrivals need no more runs, and the input is read once for all of them."""
    ticks, orders = random_stream(6)
    for row in [*ticks, *orders]:
        at = "arrival" if "arrival" in row else "registered_arrival"
        row[at] *= 5_000
    runs = []

    def sink(results, out, checkpoint):
        runs.append(out)
        return write_stream(results, out, checkpoint)

    given = spark.createDataFrame(ticks, ARRIVAL_SCHEMA), spark.createDataFrame(orders, ORDER_SCHEMA)
    path = replay_as_stream(*given, POLICIES[3], 100, 20, sink=sink)
    assert len(runs) == LEAST_SLICES
    assert flat(spark.read.parquet(path)) == model.run(ticks, orders, POLICIES[3], 100, 20)

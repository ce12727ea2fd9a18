"""Live append with commit records: failures, repeats, several writers, compaction."""

import pytest
from pyspark.sql import functions as F

from tidegate.schema import TICK_COLUMNS
from tidegate.sources import replay
from tidegate.streaming import committed


def ticks(spark, low, high):
    return replay.replay_ticks(spark, 400).where(F.col("sequence").between(low, high - 1)).select(*TICK_COLUMNS)


def sequences(spark, path):
    return sorted(r.sequence for r in committed.scan_committed(spark, path).collect())


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path)
    assert committed.append_batch(ticks(spark, 0, 50), path, "w", 0) == 50
    for _ in range(2):
        committed.append_batch(ticks(spark, 50, 80), path, "w", 1)
    committed.append_batch(ticks(spark, 80, 90), path, "other", 1)
    # Rows of a trigger that failed before its record are not part of the table ...
    committed._write_rows(ticks(spark, 90, 95), path, "w", 2, 1000)
    assert sequences(spark, path) == list(range(90))
    # ... and the trigger, run again, replaces them.
    committed.append_batch(ticks(spark, 90, 100), path, "w", 2)
    assert sequences(spark, path) == list(range(100))


def test_compaction_keeps_rows_and_repeats_stay_harmless(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    for k in range(6):
        committed.append_batch(ticks(spark, 10 * k, 10 * k + 10), path, "w", k)
    committed.append_batch(ticks(spark, 60, 160), path, "w", 6)

    def broken(*_):
        raise OSError("lost")

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(committed, "_record", broken)
        committed.compact(spark, path, small_rows=50)
    assert sequences(spark, path) == list(range(160))
    assert committed.compact(spark, path, small_rows=50) == 6
    assert sequences(spark, path) == list(range(160)) and committed.commits(spark, path).count() == 2
    committed.append_batch(ticks(spark, 20, 30), path, "w", 2)  # replayed after it was compacted
    assert sequences(spark, path) == list(range(160))
    assert committed.compact(spark, path, small_rows=50) == 0
    assert committed.compact(spark, path, small_rows=1000) == 2
    assert sequences(spark, path) == list(range(160)) and committed.commits(spark, path).count() == 1


def test_stream_that_fails_between_rows_and_record(spark, tmp_path, monkeypatch):
    source, path, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    ticks(spark, 0, 100).repartition(3).write.parquet(source)
    live = spark.readStream.schema(ticks(spark, 0, 1).schema).option("maxFilesPerTrigger", 1).parquet(source)
    own, calls = committed._record, []

    def record(*args):
        calls.append(args)
        if len(calls) == 2:
            raise OSError("lost")
        own(*args)

    monkeypatch.setattr(committed, "_record", record)
    with pytest.raises(Exception, match="lost"):
        committed.append_committed(live, path, state).awaitTermination()
    assert 0 < len(sequences(spark, path)) < 100
    committed.append_committed(live, path, state).awaitTermination()
    assert sequences(spark, path) == list(range(100))

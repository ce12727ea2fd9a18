import json

import pytest
from pyspark.sql import functions as F

from tidegate.operators.audit import audit_ticks
from tidegate.operators.compare import same_rows
from tidegate.plans.experiment import store_and_audit
from tidegate.schema import TICK_SCHEMA
from tidegate.sources import frames, kvlog, reports, ticks as store


def some_ticks(spark, n=25):
    return spark.createDataFrame([("X", i, i + 1, 99.0, 101.0) for i in range(n)], TICK_SCHEMA)


def test_append_creates_counts_and_splits_files(spark, tmp_path):
    path = str(tmp_path / "ticks")
    assert store.append_ticks(some_ticks(spark).coalesce(1), path, batch_size=10) == 25
    sizes = [spark.read.parquet(str(f)).count() for f in (tmp_path / "ticks").glob("*.parquet")]
    assert sorted(sizes) == [5, 10, 10]
    assert store.append_ticks(some_ticks(spark, 5), path) == 5
    assert store.scan_ticks(spark, path).count() == 30
    with pytest.raises(ValueError):
        store.append_ticks(some_ticks(spark), path, batch_size=0)


def test_store_and_audit_finds_gaps_and_bad_quotes(spark, tmp_path):
    assert store_and_audit(some_ticks(spark), str(tmp_path / "a")).first().complete
    holed = some_ticks(spark).where("sequence <> 7")
    assert not store_and_audit(holed, str(tmp_path / "b")).first().complete
    crossed = some_ticks(spark).withColumn("bid", F.when(F.col("sequence") == 3, 200.0).otherwise(99.0))
    report = store_and_audit(crossed, str(tmp_path / "c")).first()
    assert report.bad_quotes == 1 and not report.complete
    assert not audit_ticks(some_ticks(spark), expected_rows=26).first().complete


def test_frames(spark, tmp_path):
    lines = [
        json.dumps({"symbol": "BTC-USD", "sequence": 5, "timestamp_ns": 10000, "bid": 99, "ask": 101}),
        json.dumps({"symbol": "X", "sequence": 5, "timestamp_ns": 1, "bid": 99, "ask": 101, "v": 1}),
        json.dumps({"symbol": "X", "sequence": 5, "timestamp_ns": 1, "bid": 99}),
        "[1, 2]",
        "3",
        "no json",
    ]
    (tmp_path / "f.txt").write_text("\n".join(lines))
    good, bad = frames.read_tick_frames(spark, str(tmp_path / "f.txt"))
    assert [tuple(r) for r in good.collect()] == [("BTC-USD", 5, 10000, 99.0, 101.0)]
    assert bad.count() == 5
    frames.write_tick_frames(some_ticks(spark), str(tmp_path / "out"))
    back = frames.read_tick_frames(spark, str(tmp_path / "out"))[0]
    assert same_rows(back, some_ticks(spark)).count() == 0


def test_kv_log(spark, tmp_path):
    text = "engine=sim\nticks=100\nrate=12.50\nlock_free=true\nstart\nodd=a=b\nticks=200\nver=1.2.3\n"
    (tmp_path / "run.log").write_text(text)
    lines = kvlog.read_kv_lines(spark, str(tmp_path / "run.log"))
    kinds = {(r.key, r.text): r.kind for r in kvlog.parse_kv(lines).collect()}
    assert kinds == {
        ("engine", "sim"): "text",
        ("ticks", "100"): "int",
        ("ticks", "200"): "int",
        ("rate", "12.50"): "float",
        ("lock_free", "true"): "bool",
        ("odd", "a=b"): "text",
        ("ver", "1.2.3"): "text",
    }
    fields = {"ticks": "bigint", "rate": "double", "lock_free": "boolean", "odd": "string", "none": "bigint"}
    row = kvlog.kv_report(lines, fields).first()
    assert (row.ticks, row.rate, row.lock_free, row.odd, row.none) == (200, 12.5, True, "a=b", None)
    assert kvlog.missing_keys(lines, ["rate", "seed"]).first().missing == ["seed"]


def test_json_and_csv_reports(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2, None), ("a", 1, 0.5)], "policy string, n bigint, x double")
    nested = reports.nest(rows, "policies", ["policy"])
    document = reports.summary_document(
        {"seed": F.lit(7)}, {"policies": nested, "again": reports.nest(rows, "again", ["n"])}
    )
    reports.write_report(document, str(tmp_path / "j"), "json")
    good, bad = reports.read_json_report(spark, str(tmp_path / "j"), document.schema)
    back = reports.inline_rows(good, "policies").orderBy("position").collect()
    assert [tuple(r) for r in back] == [(0, "a", 1, 0.5), (1, "b", 2, None)]
    assert good.first().seed == 7 and bad.count() == 0
    (tmp_path / "broken.json").write_text("{not json")
    good, bad = reports.read_json_report(spark, str(tmp_path / "broken.json"), "seed int")
    assert good.count() == 0 and bad.count() == 1
    reports.write_report(rows, str(tmp_path / "c"), "csv", ["n", "policy"])
    flat = reports.read_csv_report(spark, str(tmp_path / "c"), "n bigint, policy string")
    assert sorted(tuple(r) for r in flat.collect()) == [(1, "a"), (2, "b")]
    by_policy = reports.nest(rows, "own", ["n"], ["policy"])
    assert by_policy.count() == rows.select("policy").distinct().count()

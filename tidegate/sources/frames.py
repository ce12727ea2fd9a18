"""Tick frames: one JSON object per quote with exactly the five tick keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.schema import TICK_COLUMNS, TICK_SCHEMA


def to_frames(ticks: DataFrame) -> DataFrame:
    """One text column `value` that holds the JSON frame of each quote."""
    return ticks.select(F.to_json(F.struct(*TICK_COLUMNS)).alias("value"))


def parse_frames(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ticks, quarantine): frames that are no object or have other keys are set aside.

    Columns besides `value` (an arrival number, say) are kept.
    """
    value = F.col("value")
    keys = F.array_sort(F.json_object_keys(value))
    wanted = F.array(*map(F.lit, sorted(TICK_COLUMNS)))
    rows = frames.withColumn("_ok", F.coalesce(keys == wanted, F.lit(False)))
    others = [c for c in frames.columns if c != "value"]
    ticks = rows.where("_ok").select(*others, F.from_json(value, TICK_SCHEMA).alias("t"))
    return ticks.select(*others, "t.*"), rows.where("NOT _ok").drop("_ok")


def read_tick_frames(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_frames(spark.read.text(path))


def stream_tick_frames(
    spark: SparkSession, path: str, max_files: int = 64
) -> tuple[DataFrame, DataFrame]:
    """Live frames from a folder; `max_files` bounds the intake of one batch."""
    frames = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    return parse_frames(frames)


def write_tick_frames(ticks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    to_frames(ticks).write.mode(mode).text(path)

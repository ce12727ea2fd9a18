"""key=value logs: typed values, one report row per run, required-key check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_kv_lines(spark: SparkSession, path: str) -> DataFrame:
    """(run, line, value): the file name is the run."""
    return spark.read.text(path).select(
        F.input_file_name().alias("run"), F.monotonically_increasing_id().alias("line"), "value"
    )


def parse_kv(lines: DataFrame) -> DataFrame:
    """(run, line, key, text, kind) of all lines with an '='; other lines are skipped.

    The line splits at its first '='.  'true'/'false' are bool; a value with a point is a
    float and one without is an int if it reads as such; all else stays text.
    """
    parts = F.split(F.col("value"), "=", 2)
    rows = lines.where(F.contains("value", F.lit("="))).select(
        "run", "line", parts[0].alias("key"), parts[1].alias("text")
    )
    text = F.col("text")
    kind = (
        F.when(text.isin("true", "false"), "bool")
        .when(F.contains(text, F.lit(".")) & text.try_cast("double").isNotNull(), "float")
        .when(~F.contains(text, F.lit(".")) & text.try_cast("bigint").isNotNull(), "int")
        .otherwise("text")
    )
    return rows.withColumn("kind", kind)


def kv_report(lines: DataFrame, fields: dict[str, str]) -> DataFrame:
    """One row per run with the typed `fields` (name to Spark type); the last line wins."""
    parsed = parse_kv(lines)
    picked = [
        F.max_by("text", F.when(F.col("key") == name, F.col("line"))).try_cast(kind).alias(name)
        for name, kind in fields.items()
    ]
    return parsed.groupBy("run").agg(*picked)


def missing_keys(lines: DataFrame, required: list[str]) -> DataFrame:
    """(run, missing): required keys a run does not report, empty array if complete."""
    wanted = F.array(*map(F.lit, sorted(required)))
    parsed = parse_kv(lines)
    # Only required keys are collected, so the set is bounded whatever the log holds.
    known = F.collect_set(F.when(F.col("key").isin(required), F.col("key")))
    return parsed.groupBy("run").agg(F.array_except(wanted, known).alias("missing"))

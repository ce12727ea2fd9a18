"""Audit of a stored tick table.

Distinct sequences are counted by bitmaps of 32,768 sequences: a task marks the sequences it
reads, and what is exchanged are bitmaps, not sequences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.operators.scan import AUTO, Arranged, Running, arrange, running


def bad_quote() -> Column:
    bid, ask = F.col("bid"), F.col("ask")
    return bid.isNull() | ask.isNull() | (bid <= 0) | (ask <= 0) | (bid > ask)


def _marked(table: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """One row per group and bitmap: `_part`, its number, and `_marks`, the sequences in it."""
    part = F.bitmap_bucket_number("sequence").alias("_part")
    marks = F.bitmap_construct_agg(F.bitmap_bit_position("sequence")).alias("_marks")
    return table.groupBy(*by, part).agg(marks, *more)


def audit_ticks(
    table: DataFrame, expected_rows: int | Column | None = None, by: list[str] | None = None
) -> DataFrame:
    """Counts, sequence range and bad quotes; `complete` if they are exactly 0..n-1.

    Without `expected_rows` the stored rows themselves set n.
    """
    by = by or []
    parts = _marked(
        table,
        by,
        F.count("*").alias("_rows"),
        F.min("sequence").alias("_first"),
        F.max("sequence").alias("_last"),
        F.count_if(bad_quote()).alias("_bad"),
    )
    known = F.when(F.col("_part").isNotNull(), F.bitmap_count("_marks")).otherwise(F.lit(0))
    totals = parts.groupBy(*by).agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows_read_back"),
        F.coalesce(F.sum(known), F.lit(0)).alias("distinct_sequences"),
        F.min("_first").alias("first_sequence"),
        F.max("_last").alias("last_sequence"),
        F.coalesce(F.sum("_bad"), F.lit(0)).alias("bad_quotes"),
    )
    if expected_rows is None:
        expected = F.col("rows_read_back")
    else:
        expected = expected_rows if isinstance(expected_rows, Column) else F.lit(expected_rows)
    complete = (
        (F.col("rows_read_back") == expected)
        & (F.col("distinct_sequences") == expected)
        & (F.col("first_sequence") == 0)
        & (F.col("last_sequence") == expected - 1)
        & (F.col("bad_quotes") == 0)
    )
    return totals.withColumns(
        {
            "rows_requested": expected.cast("bigint"),
            "complete": F.coalesce(complete, F.lit(False)),
        }
    )


def sequence_gaps(table: DataFrame, by: list[str], bits: int | str = AUTO) -> DataFrame:
    """Ranges of sequences missing between a group's first and last: by, first_missing,
    last_missing.

    Bitmaps become runs of present sequences; a gap lies between a run and the one before it,
    which a balanced scan finds also where a group has many runs.
    """
    runs = _marked(table.where("sequence is not null"), by).mapInArrow(
        _runs, T.StructType([*[table.schema[c] for c in by], _long("_from"), _long("_to")])
    )
    stream = arrange(runs, bits, ("_from",), tuple(by))
    before = {"_before": Running("last", F.col("_to"))}
    rows = Arranged(running(stream.rows, stream.layout, before), stream.layout).df
    return rows.where(F.col("_from") > F.col("_before") + 1).select(
        *by, (F.col("_before") + 1).alias("first_missing"), (F.col("_from") - 1).alias("last_missing")
    )


def _long(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of marked sequences of each bitmap."""
    for batch in batches:
        for at in range(batch.num_rows):
            part = batch.column("_part")[at].as_py()
            marks = np.frombuffer(batch.column("_marks")[at].as_py(), dtype=np.uint8)
            places = np.flatnonzero(np.unpackbits(marks, bitorder="little"))
            size = 8 * len(marks)
            # Sequences above zero count up from a bitmap's start, the others down.
            values = places + (part - 1) * size + 1 if part > 0 else np.sort(part * size - places)
            new = np.flatnonzero(np.diff(values) > 1)
            starts, ends = np.append(values[:1], values[new + 1]), np.append(values[new], values[-1:])
            groups = [batch.column(k).take(pa.array(np.full(len(starts), at))) for k in range(batch.num_columns - 2)]
            names = [*batch.schema.names[:-2], "_from", "_to"]
            yield pa.RecordBatch.from_arrays([*groups, pa.array(starts), pa.array(ends)], names=names)

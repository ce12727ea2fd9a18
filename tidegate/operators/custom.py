"""Rate limits supplied by the caller in place of the built-in ones."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.functions import quotes as q
from tidegate.operators.buckets import (
    arrow_table,
    each_bucket,
    flag_arrays,
    flags_type,
    in_order,
    pack,
    passing,
    quotes,
    unpack,
)
from tidegate.operators.debounce import with_previous_mid
from tidegate.operators.scan import AUTO, BUCKET, Arranged, Layout, arrange, join_carried
from tidegate.schema import ACCEPTED, DEBOUNCED
from tidegate.session import cut


GROUP_BITS = 8  # buckets per group when memories are merged


class ScanPolicy(Protocol):
    """A rate limit whose memory of many quotes is a short list of floats.

    `accept` gets the passing quotes of one symbol in one bucket, in order, and the
    memory of all earlier ones (None if there were none).  `merge` must be associative.
    """

    def summarise(self, ts: np.ndarray, mid: np.ndarray) -> list[float]: ...

    def merge(self, first: list[float], second: list[float]) -> list[float]: ...

    def accept(
        self, ts: np.ndarray, mid: np.ndarray, before: list[float] | None
    ) -> np.ndarray: ...


def _with_reason(rows: DataFrame) -> DataFrame:
    reason = (
        F.when(~passing(), F.col("gate_reason"))
        .when(F.col("accepted_signal"), ACCEPTED)
        .otherwise(DEBOUNCED)
    )
    return rows.withColumn("reason", reason)


def debounce_by_column(
    gated: DataFrame | Arranged, accept: Callable[[], Column], bits: int | str = AUTO
) -> DataFrame:
    """Policy given as a column over `mid`, `previous_mid` and `move_bps`."""
    rows = with_previous_mid(gated, bits)
    flag = F.coalesce(passing() & accept(), F.lit(False))
    return _with_reason(rows.select(*gated.columns, flag.alias("accepted_signal")))


def _memories(packed: DataFrame, policy: ScanPolicy, layout: Layout) -> DataFrame:
    """Memory in front of each (key, bucket): groups of buckets are merged first, then
    walked per key, then each group is walked with what came before it."""
    floats = T.ArrayType(T.DoubleType())
    keys = [packed.schema[k] for k in layout.keys]
    group, before = T.StructField("_group", T.LongType()), T.StructField("_before", floats)
    per_group = T.StructType([*keys, group, T.StructField("_memory", floats)])

    @F.arrow_udf(floats)
    def summary(packed: pa.Array) -> pa.Array:
        found = [
            list(policy.summarise(b.ts, b.mid)) if len(b.ts) else None for b in each_bucket(packed)
        ]
        return pa.array(found, type=pa.list_(pa.float64()))

    def step(memory, row):
        return row["_memory"] if memory is None else list(policy.merge(memory, row["_memory"]))

    def total(key, table):
        memory = None
        for row in in_order(table, BUCKET):
            memory = step(memory, row)
        return arrow_table(per_group, [[*[k.as_py() for k in key], memory]])

    def walk(place):
        schema = T.StructType([*keys, T.StructField(place, T.LongType()), before])

        def run(key, table):
            memory = table.column("_before")[0].as_py() if "_before" in table.column_names else None
            out = []
            for row in in_order(table, place):
                out.append([*[row[n] for n in schema.names[:-1]], memory])
                memory = step(memory, row)
            return arrow_table(schema, out)

        return run, schema

    rows = packed.select(*layout.cells, summary(quotes()).alias("_memory"))
    summaries = cut(rows.where(F.col("_memory").isNotNull()))
    summaries = summaries.withColumn("_group", F.shiftright(F.col(BUCKET), GROUP_BITS))
    in_group = [*layout.keys, "_group"]
    groups = summaries.groupBy(*in_group).applyInArrow(total, per_group)
    starts = groups.groupBy(*layout.keys).applyInArrow(*walk("_group"))
    joined = summaries.join(starts.hint("shuffle_hash"), in_group)
    return joined.groupBy(*in_group).applyInArrow(*walk(BUCKET))


def debounce_by_scan(
    gated: DataFrame | Arranged, policy: ScanPolicy, bits: int | str = AUTO
) -> DataFrame:
    """Policy given as an object; a symbol of any size is cut into buckets."""
    stream = arrange(gated, bits).withColumns({"mid": q.mid_price()})
    layout = stream.layout
    memories = _memories(pack(stream.rows, layout, walked_only=True), policy, layout)
    packed = join_carried(pack(stream.rows, layout), memories, layout)

    @F.arrow_udf(flags_type(["accepted_signal"]))
    def flags(packed: pa.Array, memories: pa.Array) -> pa.Array:
        marks = [
            b.mark(np.flatnonzero(policy.accept(b.ts, b.mid, before))) if len(b.ts) else b.mark([])
            for b, before in zip(each_bucket(packed), memories.to_pylist())
        ]
        return flag_arrays(packed, {"accepted_signal": marks})

    decided = flags(quotes(), F.col("_before"))
    return _with_reason(unpack(packed, list(layout.keys), decided, gated.columns))

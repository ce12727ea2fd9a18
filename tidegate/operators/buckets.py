"""Whole buckets of quotes as single rows, for rules that need an ordered walk.

The quotes of one (key, bucket), at most 2**bits of them, are packed into one array.  A
walk then is an Arrow function over these arrays: only the few columns it reads go to the
Python worker, in batches bounded by bytes, and the other columns stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.operators.scan import Layout
from tidegate.operators.spacing import NEVER
from tidegate.schema import PASS

ROWS = "_rows"
_WALKED = ["arrival", "timestamp_ns", "mid", "_passing", "_hit"]


def passing() -> Column:
    return F.col("gate_reason") == PASS


@dataclass(frozen=True)
class Bucket:
    """The passing quotes of one bucket in arrival order; `rows` are their positions."""

    size: int
    rows: np.ndarray
    ts: np.ndarray
    mid: np.ndarray
    hit: np.ndarray
    arrival: np.ndarray

    def mark(self, chosen) -> np.ndarray:
        """Flag per quote of the bucket; `chosen` selects among the passing ones."""
        flags = np.zeros(self.size, dtype=bool)
        flags[self.rows[chosen]] = True
        return flags


def pack(
    rows: DataFrame, layout: Layout, hit: Column | None = None, walked_only: bool = False
) -> DataFrame:
    """One row per (key, bucket); needs `mid` and `gate_reason`.

    Rows of an arranged table are packed where they are, so a packed table is not stored but
    made again by each step that reads it; `walked_only` packs the walked columns alone.
    """
    rows = rows.withColumns(
        {
            "_passing": F.coalesce(passing(), F.lit(False)),
            "_hit": F.coalesce(F.lit(None) if hit is None else hit, F.lit(NEVER)),
        }
    )
    fields = _WALKED if walked_only else [c for c in rows.columns if c not in layout.cells]
    return rows.groupBy(*layout.cells).agg(F.collect_list(F.struct(*fields)).alias(ROWS))


def quotes() -> Column:
    """The walked columns of a packed bucket, one array each."""
    return F.struct(*[F.col(ROWS)[c].alias(c) for c in _WALKED])


def unpack(packed: DataFrame, keys: list[str], flags: Column, columns: list[str]) -> DataFrame:
    """Back to one row per quote, with the fields of `flags` (one struct per quote)."""
    both = F.arrays_zip(F.col(ROWS).alias("row"), flags.alias("flag"))
    rows = packed.select(*keys, F.inline(both))
    inner = [c if c in keys else f"row.{c}" for c in columns]
    return rows.select(*inner, "flag.*")


def each_bucket(packed: pa.StructArray) -> Iterator[Bucket]:
    """Buckets of a batch; takes what `quotes()` gives."""
    lists = {n: packed.field(n) for n in _WALKED}
    column = {n: x.values.to_numpy(zero_copy_only=False) for n, x in lists.items()}
    bounds = lists["arrival"].offsets.to_numpy()
    for start, end in zip(bounds[:-1], bounds[1:]):
        part = {n: c[start:end] for n, c in column.items()}
        rows = np.flatnonzero(part["_passing"])
        place = part["arrival"][rows]
        if len(place) > 1 and not (place[1:] > place[:-1]).all():
            rows = rows[np.argsort(place, kind="stable")]
        walked = [part[n][rows] for n in ("timestamp_ns", "mid", "_hit", "arrival")]
        yield Bucket(int(end - start), rows, *walked)


def flag_arrays(packed: pa.StructArray, flags: dict[str, list[np.ndarray]]) -> pa.ListArray:
    """One struct of flags per quote, in the order the quotes were given."""
    empty = np.zeros(0, dtype=bool)
    columns = [pa.array(np.concatenate([empty, *parts])) for parts in flags.values()]
    marks = pa.StructArray.from_arrays(columns, list(flags))
    return pa.ListArray.from_arrays(packed.field("arrival").offsets, marks)


def flags_type(names: list[str]) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, T.BooleanType()) for n in names]))


def arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, arrow_type(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.DoubleType):
        return pa.float64()
    return pa.string() if isinstance(kind, T.StringType) else pa.int64()


def arrow_table(schema: T.StructType, records: list[list]) -> pa.Table:
    columns = list(zip(*records)) if records else [() for _ in schema.fields]
    return pa.table(
        {f.name: pa.array(list(c), type=arrow_type(f.dataType)) for f, c in zip(schema.fields, columns)}
    )


def in_order(table: pa.Table, place: str) -> list[dict]:
    order = np.argsort(table.column(place).to_numpy(), kind="stable")
    return table.take(pa.array(order)).to_pylist()

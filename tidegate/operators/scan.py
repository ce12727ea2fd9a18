"""Running values over (key, order) that stay balanced when one key is hot.

A plain window over a key puts all rows of the key into one task.  Here the order
axis is cut into buckets of at most 2**bits positions, so no window ever holds more
rows than that, whatever share of the data one key has:

1. reduce every (key, bucket) to one row, with partial aggregation before the shuffle;
2. scan these few rows per key, which gives the value carried into each bucket;
3. run the window inside each bucket and merge the carried value into it.

Rows are shuffled once and written as a Parquet table bucketed and sorted by (key, bucket,
order) (`start`).  Every later scan reads the columns it needs from it, without shuffle, and
without sort where the session takes the order of bucketed tables as given (see
`session.RECOMMENDED`).  The carried values are joined with a shuffled hash join because it
keeps the order of the big side, and because the carried side, one row per (key, bucket), is
hashed over the cluster instead of broadcast.  They are checkpointed: a later scan reads
them instead of planning the earlier scans again.

The plan is the same for a table of any size; only the number of buckets follows it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidegate.session import cut, new_path

BUCKET = "_bucket"
CELL_BITS = 14  # intended rows of the busiest key in one bucket
MAX_BITS = 20  # of a bucket of a densely numbered table, all keys together
DEFAULT_BITS = 16
PARTITION_ROWS = 4_000_000  # intended rows of one shuffle partition
SHARES = 100  # of the rows, whose densest one sets the bucket size
AUTO = "auto"


@dataclass(frozen=True)
class Layout:
    """Where scans run: key columns, order columns and bucket size."""

    keys: tuple[str, ...] = ("symbol",)
    order: tuple[str, ...] = ("arrival",)
    bits: int = DEFAULT_BITS
    parts: int = 0  # least number of shuffle partitions

    @property
    def cells(self) -> list[str]:
        return [*self.keys, BUCKET]

    @property
    def position(self) -> Column:
        return F.struct(*self.order) if len(self.order) > 1 else F.col(self.order[0])

    def ordered(self):
        return Window.partitionBy(*self.cells).orderBy(*self.order)

    def before(self):
        return self.ordered().rowsBetween(Window.unboundedPreceding, -1)

    def upto(self):
        return self.ordered().rowsBetween(Window.unboundedPreceding, 0)

    def earlier_buckets(self):
        return (
            Window.partitionBy(*self.keys)
            .orderBy(BUCKET)
            .rowsBetween(Window.unboundedPreceding, -1)
        )

    def assign(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, F.shiftright(F.col(self.order[0]), self.bits))

    def start(self, df: DataFrame) -> DataFrame:
        """The rows as an arranged table, ready for several scans: the one full write.

        Each task writes one file, sorted; windows and joins by the cells need no shuffle.
        """
        spark = df.sparkSession
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), self.parts)
        path = new_path(spark, "arranged")
        name = path.rsplit("/", 1)[1].replace("-", "_")
        (
            self.assign(df)
            .repartition(parts, *self.cells)
            .write.bucketBy(parts, *self.cells)
            .sortBy(*self.cells, *self.order)
            .option("path", path)
            .saveAsTable(name)
        )
        return spark.table(name)


@dataclass(frozen=True)
class Arranged:
    """Rows of an arranged table, with what scans added to them; `df` has no bucket column.

    Operators over one stream take it in place of a DataFrame, so the stream is written once
    for all of them.
    """

    rows: DataFrame
    layout: Layout

    @property
    def df(self) -> DataFrame:
        return self.rows.drop(BUCKET)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.rows.columns if c != BUCKET]

    def withColumns(self, columns: dict[str, Column]) -> Arranged:
        return Arranged(self.rows.withColumns(columns), self.layout)


def arrange(
    df: DataFrame | Arranged,
    bits: int | str = "auto",
    order: tuple[str, ...] = ("arrival",),
    keys: tuple[str, ...] = ("symbol",),
) -> Arranged:
    """The stream arranged for scans; one that is already arranged stays as it is."""
    if isinstance(df, Arranged):
        return df
    layout = plan_layout(df, bits, order, keys)
    return Arranged(layout.start(df), layout)


def bucket_bits(rows: int, busiest: int, extent: int) -> int:
    """Bucket size for a table of `rows`, `busiest` of them with one key, which would span
    `extent` positions if all were as dense as the densest.

    Buckets are wide enough that carried values stay few against the rows, and narrow
    enough that the busiest key has about 2**CELL_BITS rows in one.  All keys together
    have at most 2**MAX_BITS rows in a bucket of a densely numbered table.
    """
    cap = MAX_BITS + max(0, math.floor(math.log2(extent / rows)))
    return max(CELL_BITS, min(cap, CELL_BITS + round(math.log2(extent / busiest))))


def plan_layout(
    df: DataFrame,
    bits: int | str = AUTO,
    order: tuple[str, ...] = ("arrival",),
    keys: tuple[str, ...] = ("symbol",),
) -> Layout:
    """Layout with the given bucket size, or one chosen from one look at the table.

    The look counts rows per key and, in the same pass, where the shares of all rows end.
    """
    if bits != AUTO:
        return Layout(keys, order, bits)
    place = order[0]
    shares = [i / SHARES for i in range(SHARES + 1)]
    seen = Observation()
    ends = F.percentile_approx(place, shares, 100 * SHARES).alias("ends")
    counts = df.select(*keys, place).observe(seen, ends).groupBy(*keys).agg(F.count("*").alias("n"))
    busiest, total = counts.agg(F.max("n"), F.sum("n")).first()
    if not total:
        return Layout(keys, order)
    found = seen.get["ends"]
    extent = dense_extent(found, total)
    return Layout(keys, order, bucket_bits(total, busiest, extent), math.ceil(total / PARTITION_ROWS))


def axis(quotes: DataFrame, orders: DataFrame | None) -> DataFrame:
    """Positions that quotes and registrations take; both fill the buckets."""
    rows = quotes.select("symbol", "arrival")
    if orders is None:
        return rows
    return rows.unionAll(orders.select("symbol", F.col("registered_arrival").alias("arrival")))


def dense_extent(ends: list[int], rows: int) -> int:
    """Positions that all rows would span at the density of their densest share.

    Few far-off positions or long pauses so leave the bucket size alone: they make buckets
    that hold few rows, not buckets that hold most of the table.
    """
    return max(rows, (len(ends) - 1) * min(b - a for a, b in zip(ends, ends[1:])))


@dataclass(frozen=True)
class Running:
    """One running value: 'max', 'sum', or 'last' (latest value that is not null)."""

    kind: str
    value: Column
    inclusive: bool = False

    def total(self, layout: Layout) -> Column:
        """Value of a whole bucket."""
        if self.kind == "max":
            return F.max(self.value)
        if self.kind == "sum":
            return F.sum(self.value)
        return F.max_by(self.value, F.when(self.value.isNotNull(), layout.position))

    def scan(self, value: Column) -> Column:
        if self.kind == "max":
            return F.max(value)
        if self.kind == "sum":
            return F.sum(value)
        return F.last(value, ignorenulls=True)

    def local(self, layout: Layout) -> Column:
        """Running value inside the bucket."""
        return self.scan(self.value).over(layout.upto() if self.inclusive else layout.before())

    def merge(self, local: Column, carried: Column) -> Column:
        if self.kind == "max":
            return F.greatest(local, carried)
        if self.kind == "sum":
            return F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0))
        return F.coalesce(local, carried)


def join_carried(rows: DataFrame, carried: DataFrame, layout: Layout) -> DataFrame:
    return rows.join(cut(carried).hint("shuffle_hash"), layout.cells, "left")


def running(df: DataFrame, layout: Layout, specs: dict[str, Running]) -> DataFrame:
    """Add one column per running value; `df` already has its bucket column."""
    local = df.select("*", *[spec.local(layout).alias(name) for name, spec in specs.items()])
    totals = df.groupBy(*layout.cells).agg(
        *[spec.total(layout).alias(name) for name, spec in specs.items()]
    )
    carried = totals.select(
        *layout.cells,
        *[
            spec.scan(F.col(name)).over(layout.earlier_buckets()).alias(f"_carried_{name}")
            for name, spec in specs.items()
        ],
    )
    return join_carried(local, carried, layout).select(
        *df.columns,
        *[
            spec.merge(F.col(name), F.col(f"_carried_{name}")).alias(name)
            for name, spec in specs.items()
        ],
    )

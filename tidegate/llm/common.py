"""Helpers that several corpus operators share: stored steps, blocked groups, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.session import new_path


MOST_BROADCAST = 1_000_000  # rows of a few numbers, about 16 MB


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Later steps read the files, so a lost executor never repeats earlier work, and ids
    that were numbered on the way stay as they are.  `by` names columns to lay out by.
    """
    path = new_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(_laid_out(df, by)).parquet(path)


def _laid_out(df: DataFrame, by: tuple[str, ...]):
    return df.select(*[c for c in df.columns if c not in by], *by).schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not use yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


# ------------------------------------------------------------------ groups in Arrow tasks


def whole_groups(
    batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 1
) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of at least `least` rows that end where a group of equal `keys` does.

    The batches are sorted by the keys.  With each table come the starts of its groups.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held)
        starts = _group_starts(table, keys)
        if len(starts) < 2:
            continue
        # The last group may go on in the next batch.
        yield table.slice(0, starts[-1]), starts[:-1]
        held = table.slice(starts[-1]).combine_chunks().to_batches()
        rows = sum(b.num_rows for b in held)
    if rows:
        table = pa.Table.from_batches(held)
        yield table, _group_starts(table, keys)


def _group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(table.num_rows, dtype=bool)
    change[:1] = True
    for key in keys:
        column = table.column(key).to_numpy()
        change[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(change)


def in_groups(
    batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 4096
) -> Iterator[tuple[tuple, pa.Table]]:
    """Key and rows of every group of at least two rows; a few batches are held at a time."""
    for table, starts in whole_groups(batches, keys, least):
        table = table.combine_chunks()
        columns = [table.column(k).to_numpy() for k in keys]
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows]):
            if end - start > 1:
                yield tuple(column[start] for column in columns), table.slice(start, end - start)


def block_pairs(rows: DataFrame, group: str, item: Column, block: int) -> DataFrame:
    """Deal the rows of every group to pairs of blocks, so that any two rows of a group
    meet in exactly one (group, bi, bj) and no task gets more than two blocks.

    Groups of up to `block` rows are one block; a group of n rows is copied n / block
    times.  Groups of one row go, as there is no pair in them.  Adds blk, bi, bj.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("_size")).where("_size > 1")
    sizes = stored(sizes, "sizes")  # plain rows on both sides, so a large group's can be split
    blocks = F.ceil(F.col("_size") / block)
    dealt = (
        rows.join(few(sizes), group)
        .withColumn("_blocks", blocks)
        .withColumn("blk", F.pmod(F.xxhash64(item), F.col("_blocks")).cast("int"))
    )
    other = F.explode(F.sequence(F.lit(0), (F.col("_blocks") - 1).cast("int")))
    return (
        dealt.select(*rows.columns, "blk", other.alias("_other"))
        .withColumn("bi", F.least("blk", "_other"))
        .withColumn("bj", F.greatest("blk", "_other"))
        .drop("_other")
    )


def few(df: DataFrame, rows: int = MOST_BROADCAST) -> DataFrame:
    """A stored table of ids, to be sent to all executors if it is counted to be small.

    The count comes from the files' footers.  A larger one is shuffled in the join.
    """
    return F.broadcast(df) if df.count() <= rows else df


def shared_buckets(rows: DataFrame) -> DataFrame:
    """Rows (v, band) of bands with several members, one band for each set of members.

    Members that meet in many bands are so compared once.  Bands are counted before they
    are joined back, so rows of bands with one member are not dealt any further.
    """
    members = rows.groupBy("band").agg(
        F.count("*").alias("n"),
        F.min("v").alias("low"),
        F.max("v").alias("high"),
        F.bit_xor(F.xxhash64("v")).alias("mark"),
    )
    unlike = members.where("n > 1").groupBy("n", "low", "high", "mark").agg(F.min("band").alias("band"))
    one = few(stored(unlike.select("band"), "unlike"))
    return stored(rows.join(one, "band").select("band", "v"), "bands")


def sides(rows: pa.Table, bi: int, bj: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Positions of the two blocks of a pair, and whether they are one block."""
    block = rows.column("blk").to_numpy()
    if bi == bj:
        return np.arange(len(block)), np.arange(len(block)), True
    return np.flatnonzero(block == bi), np.flatnonzero(block == bj), False


class Gathered:
    """Rows of whole numbers, gathered to batches of a fair size."""

    def __init__(self, *names: str, rows: int = 8192):
        self.names, self.rows = names, rows
        self.columns: list[list] = [[] for _ in names]

    def add(self, *columns) -> Iterator[pa.RecordBatch]:
        for held, new in zip(self.columns, columns):
            held.extend(new)
        if len(self.columns[0]) >= self.rows:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.columns[0]:
            arrays = [pa.array(c, pa.int64()) for c in self.columns]
            self.columns = [[] for _ in self.names]
            yield pa.RecordBatch.from_arrays(arrays, names=list(self.names))


def arranged(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys together in one task, in order."""
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def merged(n: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Smallest reachable number for each of 0..n-1, given links between first and second."""
    label = np.arange(n)
    while True:
        lower = label.copy()
        np.minimum.at(lower, first, label[second])
        np.minimum.at(lower, second, label[first])
        lower = lower[lower]
        if np.array_equal(lower, label):
            return label
        label = lower


# ------------------------------------------------------------------ connected components


def components(edges: DataFrame) -> DataFrame:
    """Component of every vertex of `edges` (a, b: bigint): columns v, root.

    Every vertex joins the least vertex among itself and its neighbours, edges are
    redrawn between the joined ones, and this repeats until none is left.  The first
    round takes vertices in their own order, which ends stars at once; later ones in a
    fresh random order each, so that long chains shrink by a constant share per round.
    Each round is stored; nothing of it comes to the driver but whether edges are left.
    Null and self edges link nothing; vertices that have no other edges are left out.
    """
    spark = edges.sparkSession
    found = spark.createDataFrame([], "v bigint, root bigint")
    rest = stored(
        edges.where("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    level = 0
    while not rest.isEmpty():
        ends = rest.select("a", "b").unionAll(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = _order(level)
        least = ends.groupBy("a").agg(F.min(order(F.col("b"))).alias("m"))
        own = F.least(F.col("m"), order(F.col("a")))
        step = stored(least.select(F.col("a").alias("v"), own.getField("x").alias("p")), "joined")
        if level == 0:
            found = step.select("v", F.col("p").alias("root"))
        else:
            moved = step.select(F.col("v").alias("root"), "p")
            found = found.join(moved, "root", "left").select("v", F.coalesce("p", "root").alias("root"))
        found = stored(found, "found")
        left = step.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        right = step.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        redrawn = rest.join(left, "a").join(right, "b").where("pa <> pb")
        rest = stored(
            redrawn.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(),
            "edges",
        )
        level += 1
    return found


def _order(level: int):
    """Vertices in their own order at first, in a fresh random one at every later level."""
    return lambda c: F.struct((F.xxhash64(c, F.lit(level)) if level else F.lit(0)).alias("h"), c.alias("x"))

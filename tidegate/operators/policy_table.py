"""Rate limits read from a table of any number of rows, applied to one stream.

A list of policies becomes columns of one plan, which bounds its length.  A table of them
(policy, base_ns, max_ns, stress_bps) stays a table: the unit of work is one bucket of quotes
with one block of policies.  A task holds the quotes of one bucket and walks its signals once per
policy of the block.  What buckets hand on is one row per (key, bucket, policy), scanned and
composed as for a list (see `debounce`); where that would be many rows, buckets are joined to
wider ones of at most WIDE_ROWS quotes of a key, and a key with one bucket hands on nothing.
Step functions grow with the quotes of a quiet period, so a long table hands on none: with BLOCK
policies and more, a task takes the buckets of a key one after the other, a bucket at a time, and
keeps the state of its block's policies; keys and blocks are enough to keep the cores busy.
Policies with equal settings are walked once.  Quotes are shuffled once per block, of which there
are no more than keep the cores busy; neither quotes nor policies come to the driver, and quotes
are never multiplied by policies: only accepted signals are rows.

Every row of the table is a policy of its own, rows with equal names too.  A policy with
base_ns = max_ns = 0 accepts all that passes.  Unusable rows are set aside by
`quality.validate_policies`; here they raise no error but must not be given.  Columns of the
table besides these four are kept.  An empty stream accepts nothing; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import and_
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.functions import quotes as q
from tidegate.operators import spacing
from tidegate.operators.buckets import ROWS, arrow_type, passing
from tidegate.operators.debounce import STEPS, _carried_signals, group_bits
from tidegate.operators.metrics import FAULT_COLUMNS
from tidegate.operators.scan import AUTO, BUCKET, Arranged, Layout, arrange
from tidegate.session import cut

BLOCK = 64  # policies of a block at least
UNITS = 4  # blocks and buckets to work on per core
CHAINS = 2  # keys and blocks to work on per core where buckets follow each other in a task
COPIES = 16  # blocks there at most, as each is a copy of the quotes
HANDED_ROWS = 2**16  # rows that buckets hand on before they are widened
WIDE_ROWS = 2**20  # quotes of a key in a widened bucket
SENT_ROWS = 1_000_000  # of some 40 bytes each, counted; a longer table is shuffled instead
OUT_VALUES = 2**20  # numbers gathered before a task hands a batch on

_SETTINGS = ["_policy", "base_ns", "max_ns", "stress_bps"]
_CARRIED = {"mid_in": "double", "end_in": "bigint", "entry": "bigint"}


def _numbered(policies: DataFrame) -> DataFrame:
    """Every row with a number; stored, so that the numbers stay as they are."""
    typed = policies.withColumns(
        {
            "base_ns": F.col("base_ns").cast("bigint"),
            "max_ns": F.col("max_ns").cast("bigint"),
            "stress_bps": F.col("stress_bps").cast("double"),
        }
    )
    return cut(typed.withColumn("_policy", F.monotonically_increasing_id()))


def _classes(numbered: DataFrame) -> DataFrame:
    """Different settings, each with the least number of its policies."""
    return cut(numbered.groupBy(*_SETTINGS[1:]).agg(F.min("_policy").alias("_policy")))


def _per_policy(numbered: DataFrame, classes: DataFrame, found: DataFrame, how: str = "inner") -> DataFrame:
    """Rows of the table with what was found for their settings (`_policy` of `found`)."""
    named = classes.select(F.col("_policy").alias("_class"), *[F.col(c).alias(f"_{c}") for c in _SETTINGS[1:]])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _SETTINGS[1:]])
    rows = numbered.drop("_policy").join(named, same).drop(*[f"_{c}" for c in _SETTINGS[1:]])
    return rows.join(found.withColumnRenamed("_policy", "_class"), "_class", how)


def _block_of(blocks: int) -> Column:
    return F.pmod(F.xxhash64("_policy"), F.lit(blocks)).cast("int").alias("_block")


class _Quotes:
    """The passing quotes of one bucket in arrival order."""

    def __init__(self, parts: list[dict[str, np.ndarray]], before: float | None) -> None:
        whole = {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}
        self.ts, self.mid = whole["timestamp_ns"], whole["mid"]
        self.arrival = whole.get("arrival")
        self.times = self.ts.tolist()
        self.move = spacing.moves(self.mid, before)

    def open(self, p: dict, blocked_until: int) -> tuple[np.ndarray, np.ndarray, int]:
        return spacing.open_ranges(
            self.ts, self.move, p["base_ns"], p["max_ns"], p["stress_bps"], blocked_until
        )


def _walk(
    packed: DataFrame, policies: DataFrame, layout: Layout, blocks: int, tasks: int, schema: T.StructType, walked
) -> DataFrame:
    """Rows that `walked(quotes, policy)` gives for each bucket and policy.

    `policies` has the cell, the settings and what is carried into the cell.  Partitions bring
    the quotes of a cell, part by part, and then its policies; `walked` returns a list of
    values and how many numbers they hold, and batches stay bounded.
    """
    place = [*layout.cells, "_block"]
    names = [f.name for f in packed.schema["_quotes"].dataType.fields]
    each = packed.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"), F.lit(0).alias("_kind"))
    given = F.struct(*_SETTINGS, *_CARRIED).alias("_given")
    asking = policies.select(*layout.cells, _block_of(blocks), F.lit(1).alias("_kind"), given)
    both = each.unionByName(asking, allowMissingColumns=True).repartition(tasks, *place)
    arrow = arrow_type(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, parts, bucket = None, [], None
        out: list[list] = []
        held = 0
        for batch in batches:
            cells = zip(*[batch.column(n).to_pylist() for n in place])
            lists, asked = batch.column("_quotes"), batch.column("_given")
            for at, (here, kind) in enumerate(zip(cells, batch.column("_kind").to_pylist())):
                if here != cell:
                    cell, parts, bucket = here, [], None
                if kind == 0:
                    row = lists[at]
                    parts.append({n: row[n].values.to_numpy(zero_copy_only=False) for n in names})
                    continue
                p = asked[at].as_py()
                if bucket is None:
                    bucket, parts = _Quotes(parts, p["mid_in"]), []
                found, size = walked(bucket, p)
                out.append([*here[:-1], *found])
                held += size + len(schema)
                if held >= OUT_VALUES:
                    yield _batch(out, arrow)
                    out, held = [], 0
        if out:
            yield _batch(out, arrow)

    return both.sortWithinPartitions(*place, "_kind", "_at").mapInArrow(run, schema)


def _follow(
    packed: DataFrame, policies: DataFrame, layout: Layout, blocks: int, tasks: int, schema: T.StructType, walked
) -> DataFrame:
    """The same, where a task takes all buckets of a key in order with the policies of a block.

    Partitions bring the policies first and then the quotes; one bucket of these is held at a
    time, and of each policy the state in front of it.
    """
    place = [*layout.keys, "_block"]
    names = [f.name for f in packed.schema["_quotes"].dataType.fields]
    each = packed.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"), F.lit(1).alias("_kind"))
    given = F.struct(*_SETTINGS, *_CARRIED).alias("_given")
    asking = policies.select(*layout.keys, _block_of(blocks), F.lit(0).alias("_kind"), given)
    both = asking.unionByName(each, allowMissingColumns=True).repartition(tasks, *place)
    arrow = arrow_type(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, given, cell, parts, before = None, [], None, [], None
        out: list[list] = []
        held = 0

        def walk() -> Iterator[pa.RecordBatch]:
            nonlocal held, out, parts, before
            bucket, parts = _Quotes(parts, before), []
            before = float(bucket.mid[-1])
            for p in given:
                found, size = walked(bucket, p)
                out.append([*cell, *found])
                held += size + len(schema)
                if held >= OUT_VALUES:
                    yield _batch(out, arrow)
                    out, held = [], 0

        for batch in batches:
            units = zip(*[batch.column(n).to_pylist() for n in place])
            kinds, numbers = batch.column("_kind").to_pylist(), batch.column(BUCKET).to_pylist()
            lists, asked = batch.column("_quotes"), batch.column("_given")
            for at, (here, kind, number) in enumerate(zip(units, kinds, numbers)):
                if parts and (here != unit or number != cell[-1]):
                    yield from walk()
                if here != unit:
                    unit, given, before = here, [], None
                if kind == 0:
                    given.append(asked[at].as_py())
                    continue
                cell, row = (*here[:-1], number), lists[at]
                parts.append({n: row[n].values.to_numpy(zero_copy_only=False) for n in names})
        if parts:
            yield from walk()
        if out:
            yield _batch(out, arrow)

    return both.sortWithinPartitions(*place, "_kind", "_at").mapInArrow(run, schema)


def _batch(records: list[list], kind: pa.StructType) -> pa.RecordBatch:
    arrays = [pa.array(list(c), type=f.type) for f, c in zip(kind, zip(*records))]
    return pa.RecordBatch.from_arrays(arrays, names=[f.name for f in kind])


def _summary(b: _Quotes, p: dict) -> tuple[list, int]:
    """What a bucket hands on under a policy: its block end, and its signals as steps."""
    first, behind, end = b.open(p, 0)
    open_ = spacing.after_last_pause(b.ts[spacing.rows_of(first, behind, len(b.ts))], p["base_ns"])
    reach = min(b.times[0] + max(p["base_ns"], p["max_ns"]), spacing.ALWAYS)
    upto, exits = spacing.threshold_steps(open_, p["base_ns"], reach)
    settings = [p[n] for n in _SETTINGS]
    edges = [b.times[0], float(b.mid[0]), float(b.mid[-1]), end]
    return [*settings, *edges, upto, exits], 2 * len(upto)


def _accepted(b: _Quotes, p: dict) -> np.ndarray | list[int]:
    """Positions accepted; `p` then holds what the next bucket is entered with."""
    first, behind, end = b.open(p, p["end_in"])
    entry = spacing.entry_threshold(p["entry"], p["base_ns"], p["end_in"])
    chosen = spacing.accepted_in_ranges(b.ts, b.times, first, behind, p["base_ns"], entry)
    p["end_in"] = end
    if len(chosen):
        p["entry"] = b.times[chosen[-1]]
    return chosen


def _counted(b: _Quotes, p: dict) -> tuple[list, int]:
    return [p["_policy"], len(_accepted(b, p))], 0


def _listed(b: _Quotes, p: dict) -> tuple[list, int]:
    chosen = b.arrival[_accepted(b, p)]
    return [p["_policy"], chosen.tolist()], len(chosen)


def widening(most: int, cells: int, policies: int) -> int:
    """Buckets to a wider one, as a power of two; `most` quotes lie in the largest bucket."""
    if policies * cells <= HANDED_ROWS:
        return 0
    return max(0, math.floor(math.log2(WIDE_ROWS / most)))


def _walked(stream: Arranged, classes: DataFrame, walked, value: T.StructField, steps_per_call: int) -> DataFrame:
    """(key, bucket, _policy) with what `walked` makes of each bucket's signals."""
    spark, narrow = stream.rows.sparkSession, stream.layout
    long, double = T.LongType(), T.DoubleType()
    rows = stream.rows.where(passing())
    n = classes.count()
    sizes = cut(rows.groupBy(*narrow.cells).agg(F.count("*").alias("_n")))
    most, some = sizes.agg(F.max("_n"), F.count("*")).first()
    wider = widening(most or 1, some, n)
    layout = Layout(narrow.keys, narrow.order, narrow.bits + wider, narrow.parts)
    wide = F.shiftright(BUCKET, wider).alias(BUCKET)
    cells = cut(sizes.select(*layout.keys, wide).distinct())
    keys = cells.groupBy(*layout.keys).agg(F.count("*").alias("n"))
    chain, total, chains = keys.agg(F.max("n"), F.sum("n"), F.count("*")).first()
    follow = (chain or 0) > 1 and n >= BLOCK and n * some > HANDED_ROWS

    wanted = UNITS * spark.sparkContext.defaultParallelism
    blocks = max(1, min(-(-n // BLOCK), -(-wanted // (total or 1))))
    if follow:
        wanted = CHAINS * spark.sparkContext.defaultParallelism
        blocks = min(-(-n // BLOCK), -(-wanted // chains), COPIES)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), narrow.parts * blocks, min(wanted, blocks * (total or 1)))
    fields = ["timestamp_ns", "mid", *(["arrival"] if walked is _listed else [])]
    quote = F.struct("arrival", *[c for c in fields if c != "arrival"])
    packed = rows.groupBy(*narrow.cells).agg(F.array_sort(F.collect_list(quote)).alias(ROWS))
    packed = packed.select(
        *layout.keys, wide, F.col(BUCKET).alias("_at"), F.struct(*[F.col(ROWS)[c].alias(c) for c in fields]).alias("_quotes")
    )
    all_cells = keys.drop("n") if follow else cells
    all_cells = F.broadcast(all_cells) if (total or 0) <= SENT_ROWS else all_cells
    start = {"mid_in": F.lit(None), "end_in": F.lit(0), "entry": F.lit(spacing.NEVER)}
    carried = classes.crossJoin(all_cells).withColumns({c: v.cast(_CARRIED[c]) for c, v in start.items()})
    places = [T.StructField(n, cells.schema[n].dataType) for n in layout.cells]
    if (chain or 0) > 1 and not follow:
        settings = [T.StructField(c, double if c == "stress_bps" else long) for c in _SETTINGS]
        edges = [("first_ts", long), ("first_mid", double), ("last_mid", double), ("end", long)]
        longs = T.ArrayType(long)
        steps = [T.StructField("upto", longs), T.StructField("exits", longs)]
        schema = T.StructType([*places, *settings, *[T.StructField(*e) for e in edges], *steps])
        summaries = cut(_walk(packed, carried, layout, blocks, tasks, schema, _summary))
        carried = _carried(summaries, layout, steps_per_call)
    schema = T.StructType([*places, T.StructField("_policy", long), value])
    return (_follow if follow else _walk)(packed, carried, layout, blocks, tasks, schema, walked)


def _carried(summaries: DataFrame, layout: Layout, steps_per_call: int) -> DataFrame:
    """State in front of each (key, bucket, policy): mid, block end, last signal."""
    earlier = _earlier(layout)
    params = SimpleNamespace(**{c: F.col(c) for c in _SETTINGS})
    state = summaries.withColumn("mid_in", F.last("last_mid").over(earlier))
    move = q.stress_deadline(params, F.col("first_ts"), F.col("first_mid"), F.col("mid_in"))
    state = state.withColumn("end", F.greatest("end", F.coalesce(move, F.lit(0))))
    state = state.withColumn("end_in", F.coalesce(F.max("end").over(earlier), F.lit(0)))
    bits, _, several = group_bits(summaries, F.size("upto"), steps_per_call)
    # Thresholds inside a bucket lie behind its earlier blocks and the move into it.
    steps = state.select(
        *layout.cells, F.shiftright(BUCKET, bits).alias("_group"), "first_ts", "_policy", "base_ns",
        F.greatest("end_in", F.coalesce(move, F.lit(0))).alias("end"), "upto", "exits",
    )
    entries = _carried_signals(cut(steps) if several else steps, layout, several)
    return state.select(*layout.cells, *_SETTINGS, "mid_in", "end_in").join(entries, [*layout.cells, "_policy"])


def _earlier(layout: Layout):
    return Window.partitionBy(*layout.keys, "_policy").orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)


def table_signals(
    gated: DataFrame | Arranged, policies: DataFrame, bits: int | str = AUTO, steps_per_call: int = STEPS
) -> DataFrame:
    """Accepted signals of every policy: the table's columns, the key and `arrival`."""
    stream = arrange(gated, bits).withColumns({"mid": q.mid_price()})
    numbered = _numbered(policies)
    classes = _classes(numbered)
    arrivals = T.StructField("arrivals", T.ArrayType(T.LongType()))
    found = _walked(stream, classes, _listed, arrivals, steps_per_call)
    signals = found.select(*stream.layout.keys, "_policy", F.explode("arrivals").alias("arrival"))
    return _per_policy(numbered, classes, signals).select(*policies.columns, *stream.layout.keys, "arrival")


def table_metrics(
    gated: DataFrame | Arranged, policies: DataFrame, bits: int | str = AUTO, steps_per_call: int = STEPS
) -> DataFrame:
    """One report row per row of the table: its columns, quotes, signals and faults."""
    stream = arrange(gated, bits).withColumns({"mid": q.mid_price()})
    numbered = _numbered(policies)
    classes = _classes(numbered)
    count = T.StructField("accepted", T.LongType())
    found = _walked(stream, classes, _counted, count, steps_per_call)
    accepted = found.groupBy("_policy").agg(F.sum("accepted").alias("accepted_signals"))
    totals = stream.rows.agg(
        F.struct(
            F.count("*").alias("input_events"),
            F.count_if(passing()).alias("valid"),
            *[F.count_if(F.col("gate_reason") == r).alias(c) for c, r in FAULT_COLUMNS.items()],
        )
    ).scalar()
    rows = _per_policy(numbered, classes, accepted, "left").select(
        *policies.columns, F.coalesce("accepted_signals", F.lit(0)).alias("accepted_signals"), totals.alias("_t")
    )
    held = F.col("_t.valid") - F.col("accepted_signals")
    return rows.select(
        *policies.columns,
        "_t.input_events",
        "accepted_signals",
        held.alias("debounced_signals"),
        q.signal_reduction_pct(F.col("accepted_signals"), held).alias("signal_reduction_pct"),
        *[F.col("_t")[c].alias(c) for c in FAULT_COLUMNS],
    )

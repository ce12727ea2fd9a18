"""Adaptive rate limit of signals: previous mid, stress block, minimum spacing."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.functions import quotes as q
from tidegate.operators import spacing
from tidegate.operators.buckets import (
    arrow_table,
    arrow_type,
    each_bucket,
    flag_arrays,
    flags_type,
    in_order,
    pack,
    passing,
    quotes,
    unpack,
)
from tidegate.operators.scan import (
    AUTO,
    BUCKET,
    Arranged,
    Layout,
    Running,
    arrange,
    join_carried,
    plan_layout,
    running,
)
from tidegate.schema import ACCEPTED, DEBOUNCED, Policy, check_policies
from tidegate.session import cut

STEPS = 2**15  # steps of bucket functions that one call composes, or those of one bucket
MOST_GROUP_BITS = 16


def with_previous_mid(gated: DataFrame | Arranged, bits: int | str = AUTO) -> DataFrame:
    """Add the mid of the previous passing quote and the move against it."""
    rows = _previous_mid(arrange(gated, bits)).df
    return rows.withColumn("move_bps", q.move_bps(F.col("mid"), F.col("previous_mid")))


def _previous_mid(gated: Arranged) -> Arranged:
    stream = gated.withColumns({"mid": q.mid_price()})
    mid = F.when(passing(), F.col("mid"))
    rows = running(stream.rows, stream.layout, {"previous_mid": Running("last", mid)})
    return Arranged(rows, stream.layout)


def with_cooldown(gated: DataFrame | Arranged, policy: Policy, bits: int | str = AUTO) -> DataFrame:
    rows = with_previous_mid(gated, bits)
    return rows.withColumn("cooldown_ns", q.cooldown_ns(policy, F.col("move_bps")))


def stress_block(
    gated: DataFrame | Arranged, policies: list[Policy], bits: int | str = AUTO
) -> DataFrame:
    """Per (passing quote, policy): does it lie in a stress block?

    The end of the block in force is the running maximum of the deadlines set by sharp
    moves, the current quote's own included.
    """
    check_policies(policies)
    stream = _previous_mid(arrange(gated, bits))
    rows, layout = stream.rows, stream.layout
    active = [(i, p) for i, p in enumerate(policies) if not p.passthrough]
    ts = F.col("timestamp_ns")
    ends = {
        f"_end_{i}": Running(
            "max",
            F.when(passing(), q.stress_deadline(p, ts, F.col("mid"), F.col("previous_mid"))),
            inclusive=True,
        )
        for i, p in active
    }
    rows = running(rows, layout, ends).where(passing())
    flags = F.array(
        *[
            F.struct(
                F.lit(p.name).alias("policy"),
                F.lit(False).alias("blocked")
                if p.passthrough
                else F.coalesce(ts < F.col(f"_end_{i}"), F.lit(False)).alias("blocked"),
            )
            for i, p in enumerate(policies)
        ]
    )
    return rows.select(*gated.columns, F.inline(flags))


def _ends(p: Policy, ts: np.ndarray, mid: np.ndarray, before: float | None) -> np.ndarray:
    return spacing.block_ends(ts, mid, p.base_ns, p.max_ns, p.stress_bps, before)


def _bucket_summaries(
    packed: DataFrame, active: list[tuple[int, Policy]], layout: Layout
) -> DataFrame:
    """One row per (key, bucket): first and last passing quote, latest hit and block end,
    and per policy the step function of its accepted signals."""
    longs, long, double = T.ArrayType(T.LongType()), T.LongType(), T.DoubleType()
    schema = T.StructType(
        [
            T.StructField("first_ts", long),
            T.StructField("first_mid", double),
            T.StructField("last_mid", double),
            T.StructField("hit", long),
            T.StructField("ends", longs),
            T.StructField("upto", T.ArrayType(longs)),
            T.StructField("exits", T.ArrayType(longs)),
        ]
    )
    settings = [p for _, p in active]
    returned = arrow_type(schema)

    @F.arrow_udf(schema)
    def summary(packed: pa.Array) -> pa.Array:
        found = []
        for b in each_bucket(packed):
            if len(b.ts) == 0:
                found.append(None)
                continue
            ends, upto, exits = [], [], []
            for p in settings:
                end = _ends(p, b.ts, b.mid, None)
                reach = min(int(b.ts[0]) + max(p.base_ns, p.max_ns), spacing.ALWAYS)
                steps = spacing.threshold_steps(b.ts[b.ts >= end], p.base_ns, reach)
                ends.append(int(end[-1]))
                upto.append(steps[0])
                exits.append(steps[1])
            found.append(
                {
                    "first_ts": int(b.ts[0]),
                    "first_mid": float(b.mid[0]),
                    "last_mid": float(b.mid[-1]),
                    "hit": int(b.hit.max()),
                    "ends": ends,
                    "upto": upto,
                    "exits": exits,
                }
            )
        return pa.array(found, type=returned)

    rows = packed.select(*layout.cells, summary(quotes()).alias("s"))
    return cut(rows.where(F.col("s.first_ts").isNotNull()).select(*layout.cells, "s.*"))


def _carried_state(
    packed: DataFrame, active: list[tuple[int, Policy]], layout: Layout, steps_per_call: int = STEPS
) -> DataFrame:
    """State in front of each (key, bucket): mid, latest hit, block ends, last signals."""
    summaries = _bucket_summaries(packed, active, layout)
    earlier = layout.earlier_buckets()
    state = summaries.select(
        "*",
        F.last("last_mid", ignorenulls=True).over(earlier).alias("mid_in"),
        F.max("hit").over(earlier).alias("hit_in"),
    )
    moves = [
        q.stress_deadline(p, F.col("first_ts"), F.col("first_mid"), F.col("mid_in"))
        for _, p in active
    ]
    state = state.select(
        "*", *[F.coalesce(m, F.lit(0)).alias(f"_move_{i}") for (i, _), m in zip(active, moves)]
    )
    state = state.select(
        "*",
        *[
            F.coalesce(
                F.max(F.greatest(F.col("ends")[at], F.col(f"_move_{i}"))).over(earlier), F.lit(0)
            ).alias(f"end_in_{i}")
            for at, (i, _) in enumerate(active)
        ],
    )
    kept = state.select(
        *layout.cells, "mid_in", "hit_in", *[f"end_in_{i}" for i, _ in active]
    )
    if not active:
        return kept
    sizes = F.array_max(F.transform("upto", F.size))
    bits, _, several = group_bits(summaries, sizes, steps_per_call)
    steps = step_table(state, active, layout, bits)
    entries = _carried_signals(cut(steps) if several else steps, layout, several)
    signals = entries.groupBy(*layout.cells).agg(
        *[
            F.max(F.when(F.col("_policy") == at, F.col("entry"))).alias(f"entry_{i}")
            for at, (i, _) in enumerate(active)
        ]
    )
    # A bucket without passing quotes has no summary and needs no state.
    return kept.join(signals, layout.cells, "left")


def group_bits(summaries: DataFrame, sizes: Column, steps_per_call: int) -> tuple[int, int, bool]:
    """Buckets per group as a power of two, the steps of the largest bucket function, and
    whether a key may have more than one group.  `sizes` counts the steps of a summary.

    A group holds at most `steps_per_call` steps, or one bucket, which holds no more than its
    rows: so what a call gets is bounded, however hot a symbol and however long a cooldown.
    """
    most, low, high = summaries.agg(F.max(sizes), F.min(BUCKET), F.max(BUCKET)).first()
    most = max(1, most or 0)
    bits = max(0, min(MOST_GROUP_BITS, math.floor(math.log2(max(1, steps_per_call / most)))))
    return bits, most, low is not None and low >> bits != high >> bits


def step_table(state: DataFrame, active: list[tuple[int, Policy]], layout: Layout, bits: int) -> DataFrame:
    """Step functions of buckets, one row per (key, bucket, policy), in groups of buckets."""
    ends = F.array(*[F.greatest(f"end_in_{i}", f"_move_{i}") for i, _ in active]).alias("end")
    each = F.posexplode(F.arrays_zip(ends, F.col("upto"), F.col("exits"))).alias("_policy", "_step")
    steps = state.select(*layout.cells, F.shiftright(BUCKET, bits).alias("_group"), "first_ts", each)
    bases = F.array(*[F.lit(p.base_ns).cast("bigint") for _, p in active])
    return steps.select(
        *layout.cells,
        "_group",
        "first_ts",
        F.col("_policy").cast("bigint").alias("_policy"),
        F.get(bases, F.col("_policy")).alias("base_ns"),
        "_step.*",
    )


def _carried_signals(steps: DataFrame, layout: Layout, several: bool) -> DataFrame:
    """Time of the last accepted signal before each (key, bucket) and policy: `entry`.

    Groups of buckets are composed to one step function each.  From group to group the
    signals form a chain: a step's exit enters the first later step that covers it.  The
    steps that the chain visits are found by pointer doubling (`_visited`), which takes
    rounds in the logarithm of the number of groups and never walks a symbol in one task.
    Then each group is walked bucket by bucket from the exit that it is entered with.
    """
    key_fields = [steps.schema[k] for k in layout.keys]
    long, longs = T.LongType(), T.ArrayType(T.LongType())
    by_policy, by_group = [*layout.keys, "_policy"], [*layout.keys, "_policy", "_group"]

    def bucket_steps(row):
        return spacing.signal_steps(
            (row["upto"], row["exits"]), row["base_ns"], row["end"], row["first_ts"]
        )

    if several:
        schema = T.StructType(
            [
                *key_fields,
                T.StructField("_policy", long),
                T.StructField("_group", long),
                T.StructField("upto", longs),
                T.StructField("exits", longs),
            ]
        )

        def compose(key, table):
            rows = in_order(table, BUCKET)
            upto, exits = spacing.composed([bucket_steps(row) for row in rows])
            # No earlier signal is later than the first quote of the group.
            upto = [min(bound, rows[0]["first_ts"]) for bound in upto]
            return arrow_table(schema, [[*[k.as_py() for k in key], upto, exits]])

        groups = cut(steps.groupBy(*by_group).applyInArrow(compose, schema))
        exits = _visited(groups, by_policy)
        earlier = Window.partitionBy(*by_policy).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
        entries = groups.join(exits, by_group, "left").select(
            *by_group, F.coalesce(F.last("exit", True).over(earlier), F.lit(spacing.NEVER)).alias("entry")
        )
        steps = steps.join(entries.hint("shuffle_hash"), by_group)
    else:
        steps = steps.withColumn("entry", F.lit(spacing.NEVER))

    schema = T.StructType(
        [*key_fields, T.StructField("_policy", long), T.StructField(BUCKET, long), T.StructField("entry", long)]
    )

    def walk(key, table):
        value = table.column("entry")[0].as_py()
        out = []
        for row in in_order(table, BUCKET):
            out.append([*[row[n] for n in schema.names[:-1]], value])
            value = spacing.apply_steps(bucket_steps(row), value)
        return arrow_table(schema, out)

    return steps.groupBy(*by_group).applyInArrow(walk, schema)


def _visited(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Exits of the steps that each key's chain of signals visits: keys, _group, exit.

    A step covers times up to `upto`.  In order of (upto, group, step), the step after an
    exit is the first one at or behind (exit, its own group): found for all steps by one
    balanced scan from behind.  Jumps are then squared round by round.
    """
    each = F.posexplode(F.arrays_zip("upto", "exits")).alias("_rank", "_step")
    nodes = cut(
        groups.select(*keys, "_group", each)
        .select(*keys, "_group", "_rank", F.col("_step.upto").alias("upto"), F.col("_step.exits").alias("exit"))
        .withColumn("_node", F.monotonically_increasing_id())
    )
    none = F.lit(None).cast("bigint")
    targets = nodes.select(
        *keys,
        (-F.col("upto")).alias("_back"),
        (-F.col("_group")).alias("_back_group"),
        (-F.col("_rank")).alias("_back_rank"),
        F.col("_node").alias("_to"),
        none.alias("_from"),
    )
    asked = nodes.select(
        *keys,
        (-F.col("exit")).alias("_back"),
        (-F.col("_group")).alias("_back_group"),
        F.lit(-(2**31) + 1).alias("_back_rank"),
        none.alias("_to"),
        F.col("_node").alias("_from"),
    )
    both = targets.unionAll(asked)
    layout = plan_layout(both, AUTO, ("_back", "_back_group", "_back_rank"), tuple(keys))
    following = {"_next": Running("last", F.col("_to"), inclusive=True)}
    found = running(layout.start(both), layout, following).where("_from is not null and _next is not null")
    jumps = cut(found.select("_from", "_next"))
    first = nodes.groupBy(*keys).agg(F.min(F.struct("_group", "_rank", "_node")).alias("first"))
    visited = cut(first.select(F.col("first._node").alias("_node")))
    while True:
        ahead = visited.join(jumps, F.col("_node") == F.col("_from")).select(F.col("_next").alias("_node"))
        ahead = cut(ahead)
        if ahead.isEmpty():
            break
        visited = cut(visited.unionAll(ahead))
        again = jumps.select(F.col("_from").alias("_next"), F.col("_next").alias("_far"))
        jumps = cut(jumps.join(again, "_next").select("_from", F.col("_far").alias("_next")))
    return nodes.join(visited, "_node").select(*keys, "_group", "exit")


def decide(
    rows: DataFrame, policies: list[Policy], layout: Layout, steps_per_call: int = STEPS
) -> DataFrame:
    """Add `_accepted_<i>` per policy and `_first_hit` to gated rows.

    Needs `gate_reason`, `mid`, the bucket column and `_hit`, the registration of the
    order the quote hits (null for none).  `mid` and `_hit` are dropped.
    """
    active = [(i, p) for i, p in enumerate(policies) if not p.passthrough]
    columns = [c for c in rows.columns if c not in ("mid", "_hit", BUCKET)]
    walked = pack(rows, layout, F.col("_hit"), walked_only=True)
    carried = _carried_state(walked, active, layout, steps_per_call)
    packed = join_carried(pack(rows, layout, F.col("_hit")), carried, layout)
    names = ["mid_in", "hit_in", *[f"{n}_{i}" for i, _ in active for n in ("end_in", "entry")]]

    @F.arrow_udf(flags_type([*[f"_accepted_{i}" for i in range(len(policies))], "_first_hit"]))
    def flags(packed: pa.Array, state: pa.Array) -> pa.Array:
        marks = {f"_accepted_{i}": [] for i in range(len(policies))} | {"_first_hit": []}
        for b, carried in zip(each_bucket(packed), state.to_pylist()):
            for i, p in enumerate(policies):
                chosen = np.arange(len(b.rows))
                if not p.passthrough:
                    blocked = carried[f"end_in_{i}"] or 0
                    entry = carried[f"entry_{i}"]
                    end = np.maximum(_ends(p, b.ts, b.mid, carried["mid_in"]), blocked)
                    open_ = np.flatnonzero(b.ts >= end)
                    threshold = spacing.entry_threshold(
                        spacing.NEVER if entry is None else entry, p.base_ns, blocked
                    )
                    chosen = open_[spacing.accepted_rows(b.ts[open_], p.base_ns, threshold)]
                marks[f"_accepted_{i}"].append(b.mark(chosen))
            before = spacing.NEVER if carried["hit_in"] is None else carried["hit_in"]
            seen = np.maximum.accumulate(np.concatenate(([before], b.hit)))[:-1]
            marks["_first_hit"].append(b.mark(b.hit > seen))
        return flag_arrays(packed, marks)

    return unpack(packed, list(layout.keys), flags(quotes(), F.struct(*names)), columns)


def explode_policies(rows: DataFrame, policies: list[Policy]) -> DataFrame:
    """One row per (quote, policy) with `policy`, `accepted_signal` and `reason`."""
    flags = F.array(
        *[
            F.struct(F.lit(p.name).alias("policy"), F.col(f"_accepted_{i}").alias("accepted_signal"))
            for i, p in enumerate(policies)
        ]
    )
    plain = [c for c in rows.columns if not c.startswith("_accepted_")]
    reason = (
        F.when(~passing(), F.col("gate_reason"))
        .when(F.col("accepted_signal"), ACCEPTED)
        .otherwise(DEBOUNCED)
    )
    return rows.select(*plain, F.inline(flags)).withColumn("reason", reason)


def debounce(
    gated: DataFrame | Arranged,
    policies: list[Policy],
    bits: int | str = AUTO,
    steps_per_call: int = STEPS,
) -> DataFrame:
    """Apply every policy to the same gated quotes; one row per (quote, policy).

    `steps_per_call` bounds what is composed of one symbol in one call.
    """
    check_policies(policies)
    stream = arrange(gated, bits).withColumns({"mid": q.mid_price(), "_hit": F.lit(None).cast("bigint")})
    rows = decide(stream.rows, policies, stream.layout, steps_per_call)
    return explode_policies(rows.drop("_first_hit"), policies)

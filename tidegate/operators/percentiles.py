"""Exact rank selection for groups of any size, in two scans.

The first scan builds a mergeable quantile sketch per group, which brackets each wanted rank
between two values with a guaranteed error.  The second counts what lies below and above
each bracket and, value by value, what lies inside: a share of about 8 / ACCURACY of the
group.  All counts are partial aggregates, so a group with a third of the table is no special
case, and no group is collected or sorted as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000  # of the sketch: ranks are off by at most 1 / ACCURACY of the group
MARGIN = 4 / ACCURACY  # of a bracket on either side; the sketch's error and the rounding of ranks


@dataclass(frozen=True)
class Rank:
    """A zero-based rank as a function of the group's size, and the share it lies at."""

    share: float
    of: Callable[[Column], Column]


def lower_rank(p: float) -> Rank:
    """Rank floor((n - 1) * p), the rule used by all reports."""
    if not (math.isfinite(p) and 0.0 <= p <= 1.0):
        raise ValueError("percentile must lie in [0, 1]")
    return Rank(p, lambda n: F.least(n - 1, F.floor((n - 1) * F.lit(p))))


def _brackets(rows: DataFrame, keys: list[str], code: Column, ranks: dict[str, Rank]) -> DataFrame:
    """(keys..., _wanted): name, rank and bracket of every wanted rank.

    A group smaller than the sketch's accuracy is its own bracket.
    """
    shares = [s for r in ranks.values() for s in (max(0.0, r.share - MARGIN), min(1.0, r.share + MARGIN))]
    look = rows.groupBy(*keys).agg(
        F.count("*").alias("_total"),
        F.min(code).alias("_low"),
        F.max(code).alias("_high"),
        F.percentile_approx(code, shares, ACCURACY).alias("_ends"),
    )
    total, ends = F.col("_total"), F.col("_ends")
    few = total < ACCURACY
    wanted = [
        F.struct(
            F.lit(name).alias("rank_name"),
            rank.of(total).cast("bigint").alias("_rank"),
            F.when(few, F.col("_low")).otherwise(ends[2 * i]).alias("_from"),
            F.when(few, F.col("_high")).otherwise(ends[2 * i + 1]).alias("_upto"),
        )
        for i, (name, rank) in enumerate(ranks.items())
    ]
    return look.select(*keys, F.array(*wanted).alias("_wanted"))


def select_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Rank]) -> DataFrame:
    """(keys..., rank_name, value) of a numeric column; null values are ignored, nan is last."""
    rows = df.select(*keys, F.col(value).alias("_v")).where("_v is not null")
    code = F.col("_v").cast("double")  # keeps the order, so brackets of codes hold whole values
    code = F.when(F.isnan(code), F.lit(math.inf)).otherwise(code)
    brackets = _brackets(rows, keys, code, ranks)
    if keys:
        same = [F.col(f"rows.{k}").eqNullSafe(F.col(f"brackets.{k}")) for k in keys]
        both = rows.alias("rows").join(brackets.alias("brackets"), same)
        both = both.select(*[f"rows.{k}" for k in keys], "_v", "_wanted")
    else:
        both = rows.withColumn("_wanted", brackets.select("_wanted").scalar())
    side = F.when(code < F.col("_from"), -1).when(code > F.col("_upto"), 1).otherwise(0)
    cells = (
        both.select(*keys, "_v", F.inline("_wanted"))
        .select(*keys, "rank_name", "_rank", side.alias("_side"), F.when(side == 0, F.col("_v")).alias("_at"))
        .groupBy(*keys, "rank_name", "_rank", "_side", "_at")
        .agg(F.count("*").alias("_n"))
    )
    in_order = Window.partitionBy(*keys, "rank_name").orderBy("_side", "_at")
    upto = cells.withColumn("_through", F.sum("_n").over(in_order))
    picked = upto.where((F.col("_rank") < F.col("_through")) & (F.col("_rank") >= F.col("_through") - F.col("_n")))
    # The sketch's error bound keeps every rank inside its bracket; never answer if it did not.
    outside = F.raise_error(F.lit("a rank lies outside its bracket"))
    found = F.when(F.col("_side") == 0, F.col("_at")).otherwise(outside.cast(df.schema[value].dataType))
    return picked.select(*keys, "rank_name", found.alias(value))


def lower_rank_percentiles(
    df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float]
) -> DataFrame:
    """One row per group, one column per percentile, of a numeric column."""
    ranks = {name: lower_rank(p) for name, p in probabilities.items()}
    return spread(select_ranks(df, keys, value, ranks), keys, value, list(ranks))


def spread(selected: DataFrame, keys: list[str], value: str, names: list[str]) -> DataFrame:
    return selected.groupBy(*keys).agg(
        *[F.max(F.when(F.col("rank_name") == n, F.col(value))).alias(n) for n in names]
    )


def exact_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median of a double column; an even count averages the middle two."""
    ranks = {
        "low": Rank(0.5, lambda n: F.expr("(_total - 1) div 2")),
        "high": Rank(0.5, lambda n: F.expr("_total div 2")),
    }
    both = spread(select_ranks(df, keys, value, ranks), keys, value, ["low", "high"])
    return both.select(*keys, ((F.col("low") + F.col("high")) / F.lit(2.0)).alias(value))

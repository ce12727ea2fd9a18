"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic, counted in tokens.  Weights of
the cells are raked: each margin in turn is scaled to its targets, until all margins hold.
The weights are the least change that does so.  A document is then drawn with a probability
proportional to its cell's weight; the most wanted cell is kept whole, unless a budget of
tokens asks for less, or for as much of each cell as there is.

Only cells are iterated on, one row each: in one task while they are counted to be few,
else by sums per margin and joins on it.  Documents are read twice, to fill the cells and
to be drawn.  A draw is a hash of the document, so it
is the same when a task runs again.

Targets default to tokens ** FLATTEN for every margin, which lifts small sources against
large ones.  They can be given per margin as a DataFrame (value, weight); values without
one then get none.

Edge cases: a null margin is a value of its own (the empty string).  Null and empty texts
have no tokens but are drawn with their cell.  Rows with equal doc_id and text share one
draw.  A margin whose targets meet no tokens is left as it is.  An empty table gives no
rows.  Without a column `topic`, topics are told by marks in the text; see `topic_of`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.common import MOST_BROADCAST, few, fresh, stored

MARGINS = ("source", "lang", "topic")
FLATTEN = 0.9
ROUNDS = 40  # at most
CHAINED = 5  # rounds of one plan, where the cells lie in one task
TOLERANCE = 1e-6  # largest relative miss of any target
BYTES_PER_TOKEN = 4
SEED = 9


def topic_of(text: Column) -> Column:
    """Tables, licence notices, texts with an address, and prose, the first that holds."""
    return (
        F.when(text.contains("|"), "table")
        .when(text.rlike("(?i)licen[sc]e"), "licence")
        .when(text.contains("@"), "contact")
        .otherwise("prose")
    )


def token_count(text: Column) -> Column:
    """Tokens by their usual length in UTF-8 bytes, rounded up."""
    return F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / BYTES_PER_TOKEN).cast("bigint")


def _margin(documents: DataFrame, name: str, text: str) -> Column:
    column = documents[name].cast("string") if name in documents.columns else topic_of(documents[text])
    return F.coalesce(column, F.lit(""))


def raked(
    cells: DataFrame,
    margins: tuple[str, ...] = MARGINS,
    targets: dict[str, DataFrame] | None = None,
    flatten: float = FLATTEN,
    rounds: int = ROUNDS,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """Cells (margins, tokens) with a weight whose sums of tokens meet the targets."""
    total = F.sum("tokens").cast("double")
    have = cells.agg(total).first()[0]
    shares = {}
    for name in margins:
        given = (targets or {}).get(name)
        if given is None:
            wanted = cells.groupBy(name).agg(F.pow(total, F.lit(flatten)).alias("wanted"))
        else:
            own = given.select(F.coalesce(F.col("value").cast("string"), F.lit("")).alias(name), "weight")
            sums = own.groupBy(name).agg(F.sum("weight").cast("double").alias("wanted"))
            present = cells.where("tokens > 0").select(name).distinct()
            wanted = sums.join(present, name, "left_semi")
        wanted = stored(wanted, "targets")
        whole = wanted.agg(F.sum("wanted")).first()[0]
        if whole and have:
            shares[name] = wanted.select(name, (F.col("wanted") / whole * have).alias(f"target_{name}"))
    held = cells.withColumn("weight", F.lit(1.0))
    names = list(shares)
    for name in names:
        held = held.join(few(shares[name]), name, "left")
    held = stored(held, "cells")
    few_cells = held.count() <= MOST_BROADCAST
    done = 0
    while names and done < rounds:
        chained = min(CHAINED, rounds - done) if few_cells else 1
        after = held.coalesce(1) if few_cells else held
        for _ in range(chained):
            for name in names:
                after = _scaled(after, name, few_cells)
        # What the last round still moves tells how far the margins were from their targets.
        held = stored(after, "cells")
        done += chained
        counts = (F.col("weight") > 0) & (F.col("tokens") > 0)
        off = F.greatest(F.lit(0.0), *[F.when(counts, F.col(f"moved_{n}")) for n in names])
        if (held.agg(F.max(off)).first()[0] or 0.0) <= tolerance:
            break
    return held.select(*margins, "tokens", "weight")


def _scaled(cells: DataFrame, name: str, one_task: bool) -> DataFrame:
    """Weights with the sums of one margin brought to their targets.

    A table of few cells lies in one task, where the sums are windows without a shuffle;
    a larger one is summed with partial aggregation and joined.
    """
    spent = F.sum(F.col("weight") * F.col("tokens"))
    if one_task:
        summed = cells.withColumn("_sum", spent.over(Window.partitionBy(name)))
    else:
        summed = cells.join(stored(cells.groupBy(name).agg(spent.alias("_sum")), "sums"), name)
    target = F.coalesce(F.col(f"target_{name}"), F.lit(0.0))
    factor = F.when(F.col("_sum") > 0, target / F.col("_sum")).otherwise(1.0)
    moved = F.abs(F.log(F.greatest(factor, F.lit(1e-300))))
    return summed.withColumns({"weight": F.col("weight") * factor, f"moved_{name}": moved}).drop("_sum")


def mixed(
    documents: DataFrame,
    margins: tuple[str, ...] = MARGINS,
    targets: dict[str, DataFrame] | None = None,
    budget: int | None = None,
    flatten: float = FLATTEN,
    rounds: int = ROUNDS,
    seed: int = SEED,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """One row per input row: doc_id, margins, tokens, weight, probability, sampled."""
    return _drawn(
        documents.select(
            documents[doc_id].cast("bigint").alias("doc_id"), *_cell_columns(documents, margins, text, doc_id, seed)
        ),
        margins, targets, budget, flatten, rounds,
    ).select("doc_id", *margins, "tokens", "weight", "probability", "sampled")


def sampled(documents: DataFrame, margins: tuple[str, ...] = MARGINS, text: str = "text", doc_id: str = "doc_id", seed: int = SEED, **settings) -> DataFrame:
    """The rows of `documents` that are drawn, with all their columns."""
    row = fresh(documents, "row")
    inner = documents.select(
        F.struct(*[documents[c] for c in documents.columns]).alias(row),
        *_cell_columns(documents, margins, text, doc_id, seed),
    )
    defaults = {"targets": None, "budget": None, "flatten": FLATTEN, "rounds": ROUNDS}
    drawn = _drawn(inner, margins, **{**defaults, **settings})
    return drawn.where("sampled").select(f"{row}.*")


def _cell_columns(documents: DataFrame, margins: tuple[str, ...], text: str, doc_id: str, seed: int) -> list[Column]:
    draw = F.shiftrightunsigned(F.xxhash64(documents[doc_id], documents[text], F.lit(seed)), 11) / F.lit(float(2**53))
    return [
        *[_margin(documents, name, text).alias(name) for name in margins],
        token_count(documents[text]).alias("tokens"),
        draw.alias("draw"),
    ]


def _drawn(
    rows: DataFrame,
    margins: tuple[str, ...],
    targets: dict[str, DataFrame] | None,
    budget: int | None,
    flatten: float,
    rounds: int,
) -> DataFrame:
    cells = stored(rows.groupBy(*margins).agg(F.sum("tokens").alias("tokens")), "cells")
    weights = raked(cells, margins, targets, flatten, rounds)
    most, spent = weights.agg(F.max("weight"), F.sum(F.col("weight") * F.col("tokens"))).first()
    scale = (1.0 / most if most else 0.0) if budget is None else (budget / spent if spent else 0.0)
    chance = F.least(F.lit(1.0), F.col("weight") * scale)
    chances = few(stored(weights.select(*margins, "weight", chance.alias("probability")), "chances"))
    return rows.join(chances, list(margins)).withColumn("sampled", F.col("draw") < F.col("probability"))

"""Small tables with the awkward rows that every operator must take."""

from __future__ import annotations

import random

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Columns that operators use inside, with other types and values.
CLASHING = ["uid", "v", "root", "head", "n", "kept", "hash", "split", "tokens", "weight", "topic_", "key", "gone", "base"]

WORDS = ["ash", "birch", "cedar", "elm", "fir", "hazel", "larch", "maple", "oak", "pine", "rowan", "yew", "élan", "straße"]


def prose(rng: random.Random, words: int) -> str:
    out = []
    for _ in range(words):
        out.append(rng.choice(WORDS) + rng.choice(WORDS) + rng.choice(["", "", "", ",", ".", ".\n"]))
    return " ".join(out)


def texts(seed: int = 1, count: int = 40) -> list[str | None]:
    """Random prose with exact copies, near copies, nulls, empty and one very long text."""
    rng = random.Random(seed)
    found: list[str | None] = [prose(rng, rng.randint(1, 120)) for _ in range(count)]
    base = prose(rng, 200).split(" ")
    for k in range(12):
        near = list(base)
        for _ in range(k % 4):
            near[rng.randrange(len(near))] = "changed" + str(rng.randrange(99))
        found.append(" ".join(near))
    found += [found[0]] * 9 + ["", None, "  ", "one", "one", "...", "\n\n", "a b", prose(rng, 9000), "x" * 50_000]
    return found


def documents(spark, rows: list[str | None] | None = None, extra: bool = False):
    """A table of these texts; ids rise, one repeats and one is null where there are enough."""
    rows = texts() if rows is None else rows
    ids: list[int | None] = list(range(len(rows)))
    data = [(i, t, "en" if (i or 0) % 3 else None, f"s{(i or 0) % 2}", 0) for i, t in zip(ids, rows)]
    frame = spark.createDataFrame(data, DOCUMENTS).repartition(3)
    if extra:
        from pyspark.sql import functions as F

        frame = frame.withColumns({c: F.lit(f"own {c}") for c in CLASHING})
    return frame


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


def odd_rows(spark):
    """Repeated rows, a repeated id with unlike texts, and null ids."""
    rows = [(1, "same text", "en", "s", 0)] * 3 + [(2, "first", "en", "s", 0), (2, "second", None, None, None)]
    rows += [(None, "same text", "en", "s", 0), (None, None, None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCUMENTS)

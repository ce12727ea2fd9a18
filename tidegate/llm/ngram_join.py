"""Jaccard join on word shingles with Bayesian pruning of candidates.

1. Texts become sets of five-word shingles and MinHash signatures.  Equal sets are one
   class; from here on only classes are compared, weighted by their sizes.
2. Signatures are cut into bands; classes with an equal band are candidates.  32 bands of
   5 values lose a pair of similarity 0.8 once in 300,000, and rarely find one below 0.3.
   Bands that hold the same classes as another band are compared once.
3. Within a band, the signatures of two classes are compared a few values at a time.  A
   pair goes as soon as the posterior probability that its similarity reaches the
   threshold, given the values that agreed so far and a uniform prior, is under TOLERANCE.
   What remains of a band is passed on as a spanning forest, not as pairs.
4. The forests' components are groups of possible neighbours.  In each, the shingle sets
   are compared exactly, all pairs, as a product of incidence matrices.  Links are counted
   in place; again only a forest leaves the task.

Large bands and groups are dealt to pairs of blocks, so a task holds two blocks at most
and no pair is lost; pairs never become rows.

Edge cases: null, empty and wordless texts have no shingles, link with nothing and are
classes of their own; a text of fewer than five words has one shingle of all its words.
Rows with equal doc_id are rows of their own and equal texts are links.  A null doc_id is
larger than any other; a class of such rows only has a null class_id.  An empty table
gives no rows; extra columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import (
    Gathered,
    arranged,
    block_pairs,
    components,
    few,
    fresh,
    in_groups,
    merged,
    shared_buckets,
    sides,
    stored,
)
from tidegate.llm.shingles import WORDS, MinHash, set_digest, shingle_sets

SIMILARITY = 0.8
BANDS = 32
BAND_VALUES = 5
VALUES = BANDS * BAND_VALUES
STEPS = (16, 32, 64, 96, 128, VALUES)  # values compared before each decision
TOLERANCE = 1e-6
BLOCK = 256
SLICE_ROWS = 256

SKETCH = "uid bigint, doc_id bigint, digest binary, signature binary"


@cache
def least_matches(similarity: float, tolerance: float) -> tuple[int, ...]:
    """Fewest agreeing values at each step that keep a pair.

    With a uniform prior and m of n values equal, similarity follows Beta(m+1, n-m+1), and
    it reaches s with the probability that Binomial(n+1, s) is at most m.
    """
    found = []
    for n in STEPS:
        below, m = 0.0, 0
        while True:
            below += math.comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
            if below >= tolerance:
                break
            m += 1
        found.append(m)
    return tuple(found)


def surviving(
    first: np.ndarray, second: np.ndarray, same: bool, similarity: float = SIMILARITY, tolerance: float = TOLERANCE
) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose similarity may still reach the threshold after all steps."""
    needed = least_matches(similarity, tolerance)
    at = STEPS[0]
    equal = np.zeros((len(first), len(second)), dtype=np.int32)
    for k in range(at):
        equal += first[:, None, k] == second[None, :, k]
    if same:
        equal[np.tril_indices(len(first))] = -1
    a, b = np.nonzero(equal >= needed[0])
    count = equal[a, b]
    for step, least in zip(STEPS[1:], needed[1:]):
        if not len(a):
            break
        count = count + (first[a, at:step] == second[b, at:step]).sum(axis=1)
        a, b, count = (x[count >= least] for x in (a, b, count))
        at = step
    return a, b


def _sketch(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(VALUES)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                some = batch.slice(at, SLICE_ROWS)
                sets = shingle_sets(some.column("text").to_pylist(), words)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[some.column(c) for c in ("uid", "doc_id")],
                        pa.array([set_digest(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([minhash.signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["uid", "doc_id", "digest", "signature"],
                )

    return run


def _prune(similarity: float, tolerance: float):
    """Forest of the pairs of a band that may be links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Gathered("a", "b")
        for (_, bi, bj), rows in in_groups(batches, ["band", "bi", "bj"]):
            v = rows.column("v").to_numpy()
            values = np.frombuffer(b"".join(rows.column("signature").to_pylist()), dtype=np.uint16).reshape(-1, VALUES)
            left, right, same = sides(rows, bi, bj)
            a, b = surviving(values[left], values[right], same, similarity, tolerance)
            root = merged(len(v), left[a], right[b])
            joined = np.flatnonzero(root != np.arange(len(v)))
            yield from out.add(v[joined].tolist(), v[root[joined]].tolist())
        yield from out.rest()

    return run


def _set_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                some = batch.slice(at, SLICE_ROWS)
                sets = shingle_sets(some.column("text").to_pylist(), words)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[some.column(c) for c in ("v", "root", "weight")],
                        pa.array([s.tobytes() for s in sets], pa.binary()),
                    ],
                    names=["v", "root", "weight", "shingles"],
                )

    return run


def shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of left sets with right sets, exactly."""
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    often = times > 1
    number = np.cumsum(often) - 1
    keep = often[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(left), len(right)), dtype=np.float32)
    width = 4096
    for at in range(0, int(often.sum()), width):
        a, b = np.searchsorted(column, [at, at + width])
        part = np.zeros((len(sets), width), dtype=np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        total += part[left] @ part[right].T
    return total


def _verify(similarity: float):
    """Number of links of every class of a group, and a forest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Gathered("v", "links", "tree")
        for (_, bi, bj), rows in in_groups(batches, ["root", "bi", "bj"]):
            v, weight = rows.column("v").to_numpy(), rows.column("weight").to_numpy()
            sets = [np.frombuffer(s, dtype=np.uint64) for s in rows.column("shingles").to_pylist()]
            sizes = np.array([len(s) for s in sets], dtype=np.float64)
            left, right, same = sides(rows, bi, bj)
            shared = shared_counts(sets, left, right).astype(np.float64)
            union = sizes[left][:, None] + sizes[right][None, :] - shared
            linked = shared >= similarity * union - 1e-9
            if same:
                linked[np.tril_indices(len(left))] = False
            a, b = np.nonzero(linked)
            a, b = left[a], right[b]
            links = np.zeros(len(v), dtype=np.int64)
            np.add.at(links, a, weight[b])
            np.add.at(links, b, weight[a])
            root = merged(len(v), a, b)
            some = np.flatnonzero(links > 0)
            yield from out.add(v[some].tolist(), links[some].tolist(), v[root[some]].tolist())
        yield from out.rest()

    return run


def near_groups(
    documents: DataFrame, text: str = "text", doc_id: str = "doc_id", **settings
) -> DataFrame:
    """One row per input row: doc_id, class_id, n_links, kept.

    n_links counts the other rows of similarity at least `similarity`, copies included.
    class_id is the smallest doc_id reachable by links; one row of each class is kept.
    """
    rows = documents.select(documents[doc_id].cast("bigint").alias("doc_id"), documents[text].alias("text"))
    numbered = stored(rows.withColumn("uid", F.monotonically_increasing_id()), "numbered")
    return _grouped(numbered, **settings).select("doc_id", "class_id", "n_links", "kept")


def one_of_each(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", **settings) -> DataFrame:
    """The rows of `documents` that stay when one of each class does, with all columns."""
    uid = fresh(documents, "uid")
    kept = stored(documents.withColumn(uid, F.monotonically_increasing_id()), "numbered")
    rows = kept.select(
        F.col(uid).alias("uid"), kept[doc_id].cast("bigint").alias("doc_id"), kept[text].alias("text")
    )
    gone = stored(_grouped(rows, **settings).where("not kept").select(F.col("uid").alias(uid)), "gone")
    return kept.join(few(gone), uid, "left_anti").select(*documents.columns)


def _grouped(
    numbered: DataFrame,
    similarity: float = SIMILARITY,
    words: int = WORDS,
    tolerance: float = TOLERANCE,
    block: int = BLOCK,
) -> DataFrame:
    """uid, doc_id, class_id, n_links, kept for stored rows uid, doc_id, text."""
    sketch = stored(numbered.select("uid", "doc_id", "text").mapInArrow(_sketch(words), SKETCH), "sketch")
    classes = sketch.where("digest is not null").groupBy("digest").agg(
        F.min("uid").alias("v"), F.count("*").alias("weight")
    )
    classes = stored(classes, "classes")
    whole = classes.select("v", "weight")

    # Bands of the classes; of several bands that hold the same classes, one is chosen.
    signed = sketch.select(F.col("uid").alias("v"), "signature").where("signature is not null")
    signed = stored(signed.join(few(whole), "v", "left_semi"), "signed")
    width = 2 * BAND_VALUES
    keys = [F.xxhash64(F.lit(i), F.substring("signature", i * width + 1, width)) for i in range(BANDS)]
    bands = signed.select("v", F.explode(F.array(*keys)).alias("band"))
    chosen = shared_buckets(bands)
    dealt = arranged(block_pairs(signed.join(few(chosen), "v"), "band", F.col("v"), block), "band", "bi", "bj")
    possible = components(dealt.mapInArrow(_prune(similarity, tolerance), "a bigint, b bigint"))

    texts = numbered.select(F.col("uid").alias("v"), "text")
    wanted = stored(possible.join(whole, "v"), "wanted")
    sets = texts.join(few(wanted), "v").mapInArrow(
        _set_rows(words), "v bigint, root bigint, weight bigint, shingles binary"
    )
    compared = arranged(block_pairs(stored(sets, "sets"), "root", F.col("v"), block), "root", "bi", "bj")
    links = stored(compared.mapInArrow(_verify(similarity), "v bigint, links bigint, tree bigint"), "links")
    joined = components(links.select(F.col("v").alias("a"), F.col("tree").alias("b")))
    counts = links.groupBy("v").agg(F.sum("links").alias("links"))

    grouped = classes.join(joined, "v", "left").join(counts, "v", "left")
    grouped = grouped.select(
        "digest",
        F.coalesce("root", "v").alias("root"),
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
    )
    found = sketch.select("uid", "doc_id", "digest").join(grouped, "digest", "left")
    found = stored(
        found.select(
            "uid",
            "doc_id",
            F.coalesce("root", "uid").alias("root"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
        ),
        "found",
    )
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")
    heads = stored(found.groupBy("root").agg(F.min(first).alias("head")), "heads")
    return found.join(heads, "root").select(
        "uid",
        "doc_id",
        F.col("head.doc_id").alias("class_id"),
        "n_links",
        (F.col("uid") == F.col("head.uid")).alias("kept"),
    )

"""Near-duplicate vectors by cross-polytope hashing.

Vectors are compared within a label by cosine.  Equal vectors of a label are one class
first, weighted by its size.  Then:

1. Each vector is turned by random sign flips and fast Hadamard transforms, three rounds;
   its hash is the axis it lies closest to, with sign.  WIDTH hashes make a key, TABLES
   keys a vector; PROBES further keys replace one hash by the second closest axis,
   where that is nearly as close.
2. Vectors that share a key are compared exactly, in double precision.  Links leave a
   task as a spanning forest; its components are the classes of near duplicates.
3. In each component all pairs are compared and links are counted in place.

Buckets and components that are large are dealt to pairs of blocks; pairs never become rows.

Edge cases: a null label or vector, an empty or zero vector, and one with null or
non-finite components link with nothing.  Vectors of unlike lengths do not link.  Rows
with equal vec_id are rows of their own; a null vec_id is no candidate for component_id.
An empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

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
    in_groups,
    merged,
    shared_buckets,
    sides,
    stored,
)

COSINE = 0.98
WIDTH = 2
TABLES = 10
PROBES = 2
SEED = 11
BLOCK = 512


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, so squares stay finite."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of every row; their length is a power of two."""
    n, size = x.shape
    half = 1
    while half < size:
        x = x.reshape(n, size // (2 * half), 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        half *= 2
        x = x.reshape(n, size)
    return x


class CrossPolytope:
    def __init__(self, length: int, tables: int = TABLES, width: int = WIDTH, probes: int = PROBES, seed: int = SEED):
        self.size = 1 << max(1, (length - 1).bit_length())
        rng = np.random.default_rng([seed, length])
        self.flips = rng.choice([-1.0, 1.0], size=(tables, width, 3, self.size))
        self.tables, self.width, self.probes = tables, width, probes

    def keys(self, vectors: np.ndarray) -> list[np.ndarray]:
        """For each table: rows of 1 + probes bucket numbers for each vector."""
        n = len(vectors)
        padded = np.zeros((n, self.size))
        padded[:, : vectors.shape[1]] = vectors
        found = []
        for table in range(self.tables):
            axes, gaps = [], []
            for k in range(self.width):
                x = padded
                for flip in self.flips[table, k]:
                    x = hadamard(x * flip)
                x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                close = np.argpartition(-np.abs(x), 1, axis=1)[:, :2]
                size = np.take_along_axis(x, close, axis=1)
                first = np.argmax(np.abs(size), axis=1)[:, None]
                order = np.hstack([first, 1 - first])
                axis, value = np.take_along_axis(close, order, 1), np.take_along_axis(size, order, 1)
                axes.append(2 * axis + (value > 0))
                gaps.append(np.abs(value[:, 0]) - np.abs(value[:, 1]))
            base = np.array([a[:, 0] for a in axes])
            rows = [base]
            for k in np.argsort(np.array(gaps), axis=0)[: self.probes]:
                probe = base.copy()
                probe[k, np.arange(n)] = np.array([a[:, 1] for a in axes])[k, np.arange(n)]
                rows.append(probe)
            radix = (2 * self.size) ** np.arange(self.width, dtype=np.uint64)[:, None]
            found.append(np.stack([(r.astype(np.uint64) * radix).sum(axis=0) for r in rows], axis=1))
        return found


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _units(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("unit").to_pylist()), dtype=np.float64).reshape(batch.num_rows, -1)


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = batch.column("vector").to_pylist()
        rows = [unit(np.array([v], dtype=np.float64))[0].tobytes() for v in raw]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in ("v", "weight", "space", "size")], pa.array(rows, pa.binary())],
            names=["v", "weight", "space", "size", "unit"],
        )


def _bands(settings: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[int, CrossPolytope] = {}
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                some = batch.filter(pa.array(sizes == size))
                if size not in hashes:
                    hashes[size] = CrossPolytope(int(size), **settings)
                space = some.column("space").to_numpy().astype(np.uint64)
                v = some.column("v").to_numpy()
                for table, keys in enumerate(hashes[size].keys(_units(some))):
                    # A label, a vector length and a table have buckets of their own.
                    place = _scramble(space + np.uint64(int(size) * 1_000_003 + table))
                    band = _scramble(place[:, None] ^ _scramble(keys + np.uint64(table + 1)))
                    copies = band.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(v, copies)), pa.array(band.astype(np.int64).ravel())],
                        names=["v", "band"],
                    )

    return run


def _linked(rows: pa.Table, bi: int, bj: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions in one space whose cosine reaches the threshold."""
    space, size = rows.column("space").to_numpy(), rows.column("size").to_numpy()
    left, right, same = sides(rows, bi, bj)
    alike = (space[left][:, None] == space[right][None, :]) & (size[left][:, None] == size[right][None, :])
    if same:
        alike[np.tril_indices(len(left))] = False
    first, second = [], []
    for width in np.unique(size):
        a, b = left[size[left] == width], right[size[right] == width]
        vectors = rows.column("unit").to_pylist()
        x, y = (np.array([np.frombuffer(vectors[i], dtype=np.float64) for i in part]) for part in (a, b))
        if not len(a) or not len(b):
            continue
        near = (x @ y.T >= cosine) & alike[np.ix_(size[left] == width, size[right] == width)]
        i, j = np.nonzero(near)
        first.append(a[i])
        second.append(b[j])
    return np.concatenate(first or [left[:0]]), np.concatenate(second or [left[:0]])


def _forest(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Gathered("a", "b")
        for (_, bi, bj), rows in in_groups(batches, ["band", "bi", "bj"]):
            v = rows.column("v").to_numpy()
            root = merged(len(v), *_linked(rows, bi, bj, cosine))
            joined = np.flatnonzero(root != np.arange(len(v)))
            yield from out.add(v[joined].tolist(), v[root[joined]].tolist())
        yield from out.rest()

    return run


def _count(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Gathered("v", "links")
        for (_, bi, bj), rows in in_groups(batches, ["root", "bi", "bj"]):
            v, weight = rows.column("v").to_numpy(), rows.column("weight").to_numpy()
            a, b = _linked(rows, bi, bj, cosine)
            links = np.zeros(len(v), dtype=np.int64)
            np.add.at(links, a, weight[b])
            np.add.at(links, b, weight[a])
            some = np.flatnonzero(links)
            yield from out.add(v[some].tolist(), links[some].tolist())
        yield from out.rest()

    return run


def near_vectors(
    embeddings: DataFrame,
    cosine: float = COSINE,
    block: int = BLOCK,
    vector: str = "embedding",
    label: str = "label",
    vec_id: str = "vec_id",
    **settings,
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    `settings` are those of CrossPolytope: tables, width, probes, seed.
    """
    rows = embeddings.select(
        F.monotonically_increasing_id().alias("uid"),
        embeddings[vec_id].cast("bigint").alias("vec_id"),
        embeddings[label].alias("label"),
        embeddings[vector].cast("array<double>").alias("vector"),
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = (
        F.col("label").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0)
        & finite & F.exists("vector", lambda x: x != 0)
    )
    rows = stored(rows.withColumn("vector", F.when(usable, F.col("vector"))), "vectors")
    valid = rows.where("vector is not null")
    classes = valid.groupBy("label", "vector").agg(F.min("uid").alias("v"), F.count("*").alias("weight"))
    classes = stored(classes, "classes")
    plain = classes.select("v", "weight", F.xxhash64("label").alias("space"), F.size("vector").alias("size"), "vector")
    units = stored(plain.mapInArrow(_normalise, "v bigint, weight bigint, space bigint, size int, unit binary"), "units")

    chosen = shared_buckets(units.mapInArrow(_bands(settings), "v bigint, band bigint").distinct())
    dealt = arranged(block_pairs(units.join(few(chosen), "v"), "band", F.col("v"), block), "band", "bi", "bj")
    joined = components(dealt.mapInArrow(_forest(cosine), "a bigint, b bigint"))
    compared = arranged(block_pairs(units.join(few(joined), "v"), "root", F.col("v"), block), "root", "bi", "bj")
    links = compared.mapInArrow(_count(cosine), "v bigint, links bigint")
    counts = links.groupBy("v").agg(F.sum("links").alias("links"))

    known = classes.join(joined, "v", "left").join(counts, "v", "left").select(
        F.col("label"),
        F.col("vector"),
        F.coalesce("root", "v").alias("root"),
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
    )
    found = rows.join(known, ["label", "vector"], "left")
    found = stored(
        found.select("vec_id", F.coalesce("root", "uid").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")),
        "found",
    )
    heads = stored(found.groupBy("root").agg(F.min("vec_id").alias("component_id")), "heads")
    return found.join(heads, "root").select(
        "vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    )

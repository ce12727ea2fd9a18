"""Whitening of embeddings from an exact integer scatter matrix.

Every entry c becomes the whole number x = floor(64 c) + 1000000, so that means and
cross-products have exact values.  The fit uses each distinct x vector once:

1. rows are encoded in as few bytes per entry as they need and made distinct by a shuffle;
2. each task shifts a block of rows to start at zero, cuts every dimension into bit planes
   and packs a plane's bits across the rows into 64-bit words.  The number of ones in the
   AND of two planes, weighted by the planes' powers of two, summed over all pairs of
   planes, is the cross-product of two dimensions (`scatter`);
3. tasks send their sums as 32-bit limbs, Spark adds them, and one small group per vector
   length centres them as integers (n * sum(xy) - sum(x) * sum(y)) before `eigh`.

A fit holds d * d numbers for vectors of length d, whatever the number of rows.  Vectors of
unlike length have a fit each.  Fits are sent to the tasks in portions of `MODEL_BYTES`.

Defined cases: a vector that is null, empty, or holds a null or non-finite entry is left
out, and all of its rows; entries beyond 2**61 / 64 count as that bound; repeated ids stay,
one set of rows each; a null id is an id.  A component whose eigenvalue is zero within
double precision has `explained` as computed and null `whitened`, and takes no part in
`identity_error`; `deviation` is null if it does not fit into 64 bits.  An empty table gives
an empty result.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.llm.common import stored

SCALE = 64
OFFSET = 1_000_000
MOST = 2**61  # of a scaled entry, either sign
COMPONENTS = 16
BLOCK = 4096  # rows whose bits are packed together
CELLS = 2**21  # numbers of unfinished sums that a task holds before it sends them
MODEL_BYTES = 32 << 20  # fits sent to the tasks at once
LIMBS = 5
_LIMB_BITS = 32


# ---------------------------------------------------------------------- vectors in tasks


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row positions and x vectors (rows by dimensions) of the usable lists, by length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    usable = column.is_valid().to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy().astype(np.int64)
    entries = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null: nan
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(entries))))
    lengths = offsets[1:] - offsets[:-1]
    usable &= (bad[offsets[1:]] == bad[offsets[:-1]]) & (lengths > 0)
    for dim in np.unique(lengths[usable]).tolist():
        rows = np.flatnonzero(usable & (lengths == dim))
        with np.errstate(over="ignore"):
            scaled = np.floor(entries[offsets[rows][:, None] + np.arange(dim)] * SCALE)
        yield rows, np.clip(scaled, -MOST, MOST).astype(np.int64) + OFFSET


def encoded(x: np.ndarray) -> list[bytes]:
    """Every row of x in the least of 1, 2, 4 or 8 bytes per entry that hold it."""
    shifted = x - OFFSET
    size = np.full(len(x), 8)
    for width in (4, 2, 1):
        top = 2 ** (8 * width - 1)
        size[((shifted >= -top) & (shifted < top)).all(axis=1)] = width
    out: list[bytes] = [b""] * len(x)
    for width in np.unique(size).tolist():
        rows = np.flatnonzero(size == width)
        for at, row in zip(rows.tolist(), shifted[rows].astype(f"<i{width}")):
            out[at] = row.tobytes()
    return out


def decoded(texts: list[bytes], dim: int) -> np.ndarray:
    """The x vectors of `encoded`, in any order."""
    parts = []
    for width in (1, 2, 4, 8):
        held = b"".join(t for t in texts if len(t) == width * dim)
        parts.append(np.frombuffer(held, dtype=f"<i{width}").reshape(-1, dim).astype(np.int64))
    return np.concatenate(parts) + OFFSET


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """Each distinct x vector of the column `vector` once: dim, x."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in matrices(batch.column(0)):
                dims = pa.array(np.full(len(rows), x.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays([dims, pa.array(encoded(x), pa.binary())], names=["dim", "x"])

    return vectors.select("vector").mapInArrow(encode, "dim int, x binary").distinct()


def by_length(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[np.ndarray]:
    """x vectors of the fit list in blocks of at most `rows` vectors of one length."""
    held: dict[int, list[bytes]] = {}
    for batch in batches:
        for dim, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            waiting = held.setdefault(dim, [])
            waiting.append(text)
            if len(waiting) == rows:
                yield decoded(held.pop(dim), dim)
    for dim, waiting in held.items():
        yield decoded(waiting, dim)


# ---------------------------------------------------------------- exact sums of products


def bit_planes(y: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Planes of the unsigned y as words over the rows, with their dimension and weight.

    `bits` is the number of planes per dimension; planes are in order of dimension.
    """
    rows = len(y)
    owner = np.repeat(np.arange(len(bits)), bits)
    starts = np.concatenate(([0], np.cumsum(bits)))
    power = np.arange(len(owner)) - starts[owner]
    packed = np.zeros((len(owner), -(-rows // 64) * 8), dtype=np.uint8)
    for b in range(int(bits.max(initial=0))):
        plane = np.packbits(((y >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=0)
        with_bit = np.flatnonzero(bits > b)
        packed[starts[with_bit] + b, : len(plane)] = plane[:, with_bit].T
    return packed.view(np.uint64), owner, power


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums per dimension and sums of products per pair i <= j, as Python numbers."""
    rows, dim = x.shape
    low = x.min(axis=0)
    y = x.astype(np.uint64) - low.astype(np.uint64)  # no overflow: the wrapped difference is exact
    bits = np.array([int(top).bit_length() for top in y.max(axis=0)])
    planes, owner, power = bit_planes(y, bits)
    fits = 2 * int(bits.max()) + rows.bit_length() < 63
    weight = np.array([1 << int(p) for p in power], dtype=np.int64 if fits else object)
    present = np.flatnonzero(bits)
    first = np.concatenate(([0], np.cumsum(bits)))[present]
    products = np.zeros((dim, dim), dtype=weight.dtype)
    sums = np.zeros(dim, dtype=object)
    for p in range(len(planes)):
        i = owner[p]
        own = np.searchsorted(present, i)
        ones = np.bitwise_count(planes[first[own] :] & planes[p]).sum(axis=1, dtype=np.int64)
        if not fits:
            ones = ones.astype(object)
        weighted = np.add.reduceat(ones * weight[first[own] :], first[own:] - first[own])
        products[i, present[own:]] += weighted * weight[p]
        sums[i] += int(np.bitwise_count(planes[p]).sum(dtype=np.int64)) << int(power[p])
    low = low.astype(object)
    products = products.astype(object)
    products += low[:, None] * sums + sums[:, None] * low + rows * (low[:, None] * low)
    return sums + rows * low, products


def _limbs(i: np.ndarray, j: np.ndarray, dim: int, values: np.ndarray) -> pa.RecordBatch:
    """Whole numbers of any size as limbs that add up without overflow."""
    mask = 2**_LIMB_BITS - 1
    parts = [(values >> (_LIMB_BITS * k)) & mask for k in range(LIMBS - 1)]
    parts.append(values >> (_LIMB_BITS * (LIMBS - 1)))
    arrays = [pa.array(np.full(len(i), dim), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32())]
    arrays += [pa.array(p.astype(np.int64)) for p in parts]
    return pa.RecordBatch.from_arrays(arrays, names=["dim", "i", "j", *[f"l{k}" for k in range(LIMBS)]])


def sums_of_products(fit_list: DataFrame) -> DataFrame:
    """Sums over the fit list: rows (dim, i, j) with i = j = -1 for the number of vectors,
    i = -1 for the sum of dimension j, else the sum of the products of i <= j, in limbs."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for dim, (n, sums, products) in held.items():
                i, j = np.triu_indices(dim)
                rows = np.concatenate((np.full(dim + 1, -1), i))
                columns = np.concatenate(([-1], np.arange(dim), j))
                values = np.concatenate((np.array([n], dtype=object), sums, products[i, j]))
                yield _limbs(rows, columns, dim, values)
            held.clear()

        for x in by_length(batches, BLOCK):
            sums, products = scatter(x)
            total = held.setdefault(x.shape[1], [0, 0, 0])
            total[0] += len(x)
            total[1] = total[1] + sums
            total[2] = total[2] + products
            if sum(dim * dim for dim in held) > CELLS:
                yield from sent()
        yield from sent()

    limbs = [f"l{k}" for k in range(LIMBS)]
    schema = "dim int, i int, j int, " + ", ".join(f"{c} bigint" for c in limbs)
    parts = fit_list.mapInArrow(add, schema)
    return parts.groupBy("dim", "i", "j").agg(*[F.sum(c).alias(c) for c in limbs])


# ------------------------------------------------------------------------------- the fit

MODEL = "dim int, n bigint, mean array<bigint>, rest array<bigint>, axes array<double>, values array<double>, trace double"


def principal(n: int, sums: np.ndarray, products: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Unit eigenvectors (as rows) and eigenvalues of the covariance, largest first, and its
    trace.  `products` holds the sums for i <= j; all arguments are Python numbers."""
    centred = n * np.triu(products) - np.triu(sums[:, None] * sums)
    upper = (centred / (n * n)).astype(np.float64)  # a quotient of whole numbers, rounded once
    covariance = upper + np.triu(upper, 1).T
    values, axes = np.linalg.eigh(covariance)
    keep = np.argsort(-values, kind="stable")[:most]
    return axes.T[keep], values[keep], float(np.trace(covariance))


def fitted(fit_list: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per vector length: mean as whole part and rest over n, axes, eigenvalues."""

    def solve(key, table):
        dim = key[0].as_py()
        limbs = [table.column(f"l{k}").to_pylist() for k in range(LIMBS)]
        numbers = [sum(v << (_LIMB_BITS * k) for k, v in enumerate(parts)) for parts in zip(*limbs)]
        n, sums, products = 0, np.zeros(dim, dtype=object), np.zeros((dim, dim), dtype=object)
        for i, j, value in zip(table.column("i").to_pylist(), table.column("j").to_pylist(), numbers):
            if i >= 0:
                products[i, j] = value
            elif j >= 0:
                sums[j] = value
            else:
                n = value
        axes, values, trace = principal(n, sums, products, components)
        row = {
            "dim": [dim],
            "n": [n],
            "mean": [[s // n for s in sums]],
            "rest": [[s % n for s in sums]],
            "axes": [axes.ravel().tolist()],
            "values": [values.tolist()],
            "trace": [trace],
        }
        return pa.table(row, schema=returned)

    longs, doubles = pa.list_(pa.int64()), pa.list_(pa.float64())
    returned = pa.schema(
        [("dim", pa.int32()), ("n", pa.int64()), ("mean", longs), ("rest", longs), ("axes", doubles), ("values", doubles), ("trace", pa.float64())]
    )
    return sums_of_products(fit_list).groupBy("dim").applyInArrow(solve, MODEL)


@dataclass(frozen=True)
class Fit:
    """The fit of one vector length, as tasks use it."""

    n: int
    mean: np.ndarray
    rest: np.ndarray
    axes: np.ndarray
    values: np.ndarray
    trace: float
    error: float | None = None

    def projected(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates; nan for a component without spread."""
        centred = (x - self.mean) - self.rest / self.n
        least = len(self.mean) * np.finfo(np.float64).eps * self.trace
        scale = np.where(self.values > least, self.values, np.nan)
        return centred @ self.axes.T / np.sqrt(scale)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sum over dimensions of (n x - S) squared."""
        apart = x - self.mean
        most = self.n * (int(np.abs(apart).max(initial=0)) + 1)
        if len(self.mean) * most * most < 2**63:
            return ((self.n * apart - self.rest) ** 2).sum(axis=1).tolist()
        exact = ((self.n * apart.astype(object) - self.rest.astype(object)) ** 2).sum(axis=1)
        return [v if v < 2**63 else None for v in exact]


def _portions(models: DataFrame) -> Iterator[dict[int, Fit]]:
    """Fits of all lengths, in portions of about MODEL_BYTES."""
    lengths = sorted(r.dim for r in models.select("dim").collect())
    while lengths:
        taken, size = [], 0
        while lengths and (not taken or size < MODEL_BYTES):
            taken.append(lengths.pop(0))
            size += 8 * taken[-1] * (COMPONENTS + 2)
        rows = models.where(F.col("dim").isin(taken)).collect()
        yield {
            r.dim: Fit(
                r.n,
                np.array(r["mean"]),
                np.array(r.rest),
                np.array(r.axes).reshape(len(r["values"]), r.dim),
                np.array(r["values"]),
                r.trace,
            )
            for r in rows
        }


def _with_errors(fit_list: DataFrame, fits: dict[int, Fit]) -> dict[int, Fit]:
    """The fits with the largest entry of (covariance of the whitened fit list - identity)."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for x in by_length(batches, BLOCK):
            if x.shape[1] not in fits:
                continue
            white = np.nan_to_num(fits[x.shape[1]].projected(x))
            ones = np.hstack([np.ones((len(white), 1)), white])
            held[x.shape[1]] = held.get(x.shape[1], 0) + ones.T @ ones
        for dim, total in held.items():
            i, j = np.indices(total.shape).reshape(2, -1)
            arrays = [np.full(len(i), dim, dtype=np.int32), i.astype(np.int32), j.astype(np.int32), total.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["dim", "i", "j", "v"])

    parts = fit_list.mapInArrow(moments, "dim int, i int, j int, v double")
    totals: dict[int, np.ndarray] = {}
    for r in parts.groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).collect():
        k = len(fits[r.dim].values) + 1
        totals.setdefault(r.dim, np.zeros((k, k)))[r.i, r.j] = r.v
    found = {}
    for dim, fit in fits.items():
        n, first, second = totals[dim][0, 0], totals[dim][0, 1:], totals[dim][1:, 1:]
        present = np.flatnonzero(np.isfinite(fit.projected(fit.mean[None, :])[0]))
        covariance = second / n - np.outer(first / n, first / n)
        apart = np.abs(covariance - np.eye(len(first)))[np.ix_(present, present)]
        error = float(apart.max()) if len(present) else None
        found[dim] = Fit(fit.n, fit.mean, fit.rest, fit.axes, fit.values, fit.trace, error)
    return found


def whitened(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """A row per usable vector and component: id, component, n, deviation, whitened,
    explained, identity_error."""
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector"))
    fit_list = stored(distinct_vectors(rows), "fit-list")
    models = stored(fitted(fit_list, components), "fits")
    schema = T.StructType(
        [
            T.StructField(id_column, rows.schema["id"].dataType),
            T.StructField("component", T.IntegerType()),
            T.StructField("n", T.LongType()),
            T.StructField("deviation", T.LongType()),
            T.StructField("whitened", T.DoubleType()),
            T.StructField("explained", T.DoubleType()),
            T.StructField("identity_error", T.DoubleType()),
        ]
    )
    found = vectors.sparkSession.createDataFrame([], schema)
    for portion in _portions(models):
        found = found.unionAll(_applied(rows, _with_errors(fit_list, portion), schema))
    return found


def _applied(rows: DataFrame, fits: dict[int, Fit], schema: T.StructType) -> DataFrame:
    names = schema.fieldNames()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in matrices(batch.column(1)):
                if x.shape[1] not in fits:
                    continue
                fit = fits[x.shape[1]]
                k = len(fit.values)
                ids = batch.column(0).take(pa.array(np.repeat(at, k)))
                white = fit.projected(x).ravel()
                share = fit.values / fit.trace if fit.trace > 0 else np.full(k, np.nan)
                deviation = pa.array(fit.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k)))
                arrays = [
                    ids,
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(k * len(at), fit.n)),
                    deviation,
                    pa.array(white, from_pandas=True),
                    pa.array(np.tile(share, len(at)), from_pandas=True),
                    pa.array([fit.error] * (k * len(at)), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.mapInArrow(apply, schema)

"""Whitening against plain numpy and Python whole numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.llm import queries, whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, components=16):
    """The contract with Python numbers, one dimension count."""
    usable = [
        (i, [int(math.floor(64 * float(np.float32(c)))) + 1000000 for c in v])
        for i, v in rows
        if v and all(c is not None and math.isfinite(c) for c in v)
    ]
    fit = sorted({tuple(x) for _, x in usable})
    n, dim = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(dim)]
    exact = [[n * sum(x[i] * x[j] for x in fit) - sums[i] * sums[j] for j in range(dim)] for i in range(dim)]
    covariance = np.array([[v / n**2 for v in row] for row in exact])
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    out = {}
    for i, x in usable:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        centred = np.array([(n * a - s) / n for a, s in zip(x, sums)])
        out[i] = (n, deviation, centred @ axes / np.sqrt(values))
    return out, values / np.trace(covariance)


def same_axes(found, expected):
    """Equal up to the sign of each component."""
    signs = np.sign((found * expected).sum(axis=0))
    return np.allclose(found * signs, expected, rtol=1e-7, atol=1e-9)


def test_against_plain_numbers(spark):
    rng = np.random.default_rng(3)
    mixed = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) + 5
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(mixed)]
    rows += [(1000 + i, rows[0][1]) for i in range(50)]  # copies count once
    odd = [(2001, None), (2002, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2003, [float("nan")] * 6), (2004, [])]
    odd += [(2005, [1.0, float("inf"), 0.0, 0.0, 0.0, 0.0])]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows + odd], SCHEMA).repartition(5)
    got = whitening.whitened(table.withColumn("dim", F.lit("own")).withColumn("n", F.lit(1))).toPandas()
    expected, shares = plain(rows)
    assert sorted(got.vec_id.unique()) == sorted(expected) and len(got) == 6 * len(expected)
    wide = got.pivot(index="vec_id", columns="component", values="whitened")
    assert list(wide.columns) == [1, 2, 3, 4, 5, 6]
    assert same_axes(wide.to_numpy(), np.array([expected[i][2] for i in wide.index]))
    one = got.drop_duplicates("vec_id").set_index("vec_id")
    assert {i: (r.n, r.deviation) for i, r in one.iterrows()} == {i: e[:2] for i, e in expected.items()}
    assert np.allclose(got.groupby("component").explained.first(), shares, rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9


def test_scatter_is_exact():
    rng = random.Random(5)
    for top in (1, 3, 200, 2**20, 2**45, 2**60):
        x = np.array([[rng.randint(-top, top) for _ in range(4)] for _ in range(131)], dtype=np.int64)
        x[:, 2] = 7  # a dimension without spread
        sums, products = whitening.scatter(x)
        rows = x.tolist()
        assert sums.tolist() == [sum(r[j] for r in rows) for j in range(4)]
        for i in range(4):
            for j in range(i, 4):
                assert products[i, j] == sum(r[i] * r[j] for r in rows)


def test_encoding_is_one_to_one():
    rng = np.random.default_rng(1)
    for top in (2, 100, 30_000, 2**30, 2**60):
        x = rng.integers(-top, top, size=(40, 3)) + whitening.OFFSET
        back = whitening.decoded(whitening.encoded(x), 3)
        assert sorted(map(tuple, back.tolist())) == sorted(map(tuple, x.tolist()))


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whitened(empty).collect() == []
    useless = spark.createDataFrame([(1, None, 0), (2, [], 0)], SCHEMA)
    assert whitening.whitened(useless).collect() == []
    # One vector, and vectors of another length with a spread in one direction only; huge entries.
    rows = [(1, [1.0]), (None, [0.0, 1.0]), (3, [0.0, 3.0]), (3, [0.0, 3.0]), (4, [3.0e38, 0.0, 0.0]), (5, [-3.0e38, 1.0, 0.0])]
    got = whitening.whitened(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).collect()
    assert len(got) == 1 + 2 * 3 + 3 * 2
    alone = [r for r in got if r.vec_id == 1][0]
    assert (alone.n, alone.deviation, alone.whitened, alone.explained) == (1, 0, None, None)
    pair = {(r.vec_id, r.component): r for r in got if r.vec_id in (None, 3)}
    assert pair[None, 1].n == 2 and abs(pair[3, 1].whitened) == pytest.approx(1.0)
    assert pair[3, 2].whitened is None and pair[3, 1].identity_error < 1e-12
    assert {r.deviation for r in got if r.vec_id in (4, 5)} == {None}


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    got = queries.QUERIES["op11_whitening"](spark, folder).toPandas()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    expected, shares = plain(rows)
    wide = got.pivot(index="vec_id", columns="component", values="whitened")
    assert same_axes(wide.to_numpy(), np.array([expected[i][2] for i in wide.index]))
    assert {(r.vec_id, r.n, r.deviation) for r in got.itertuples()} == {(i, *e[:2]) for i, e in expected.items()}
    assert got.identity_error.iloc[0] <= 0.0001

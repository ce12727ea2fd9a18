"""Language-model scores against plain dictionaries, and the filter by itself."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.llm import language_model as lm
from tidegate.llm import queries

from . import samples


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", lower) if w] + [None]


def out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def plain(rows, prior):
    """Per row: tokens, known ones, base and model score; (doc_id, text) in, exact levels."""
    learned = [tokens(t) for i, t in rows if not out(i)]
    c = Counter(w for ws in learned for w in ws)
    pairs = Counter(p for ws in learned for p in zip(["start", *ws], ws))
    n, v = sum(c.values()), len(c)
    found = []
    for doc_id, text in rows:
        ws = tokens(text)
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        score = 0.0
        for k, w in enumerate(ws):
            before = c[ws[k - 1]] if k else c[None]
            count = pairs[(ws[k - 1] if k else "start", w)]
            level = count.bit_length()
            stands = math.sqrt(2 ** (level - 1) * (2**level - 1)) if level else 0
            together = min(stands, before, c[w])
            score += math.log10((together + prior * (c[w] + 1) / (n + v + 1)) / (before + prior))
        found.append((doc_id, out(doc_id), len(ws), sum(c[w] > 0 for w in ws), n, base, score))
    return found


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6)))


def same(got, expected):
    got, expected = ordered(got), ordered(expected)
    assert [r[:5] for r in got] == [r[:5] for r in expected]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in expected], rtol=1e-9)


def with_fold(docs):
    return docs.withColumn("held_out", lm.held_out(F.col("doc_id")))


EXACT = lm.Settings(prior=3.0, bits=300)  # so wide that no false hit is to be expected


@pytest.mark.parametrize(
    "settings",
    [
        EXACT,
        lm.Settings(prior=3.0, bits=300, chunk_bytes=2_000),
        lm.Settings(prior=3.0, bits=300, chunk_bytes=9_000, bucket_pairs=500, slice_bytes=20_000),
    ],
)
def test_against_dictionaries(spark, settings):
    texts = samples.texts() + ["A b\tA\x0bb\x1ca B", "ÉCOLE école", "end\r\n"] * 3
    rows = list(enumerate(texts)) + [(None, texts[3]), (7, "again"), (7, "again")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    docs = docs.withColumns({c: F.lit("own") for c in ("chunk", "at", "kind", "word", "hash", "c", "bits")})
    same(lm.scored(with_fold(docs), settings).collect(), plain(rows, 3.0))


def test_filter_never_misses_and_seldom_errs():
    rng = np.random.default_rng(4)
    pairs = rng.integers(0, 2**63, size=40_000, dtype=np.int64).view(np.uint64) * np.uint64(2)
    counts = np.minimum(rng.zipf(1.7, size=len(pairs)), 10**6)
    bits = 2
    bucket = lm.bucket_of(pairs, bits)
    parts = [lm.built(lm.key_of(pairs[bucket == b]), counts[bucket == b], 10) for b in range(4)]
    size = 8 * sum(map(len, parts))
    assert size * 8 <= 10 * lm.levels(counts).sum() + 4 * 64
    inside, level = lm.Slice(0, bits, parts).level(pairs)
    assert len(inside) == len(pairs) and (level >= lm.levels(counts)).all()
    assert (level > lm.levels(counts)).mean() < 0.05
    strange = rng.integers(0, 2**63, size=40_000, dtype=np.int64).view(np.uint64)
    _, level = lm.Slice(0, bits, parts).level(strange)
    assert (level > 0).mean() < 0.05
    # A slice answers for its own buckets only.
    inside, _ = lm.Slice(1, bits, parts[1:3]).level(pairs)
    assert set(inside.tolist()) == set(np.flatnonzero((bucket == 1) | (bucket == 2)).tolist())


def test_levels_and_packing():
    counts = np.array([1, 2, 3, 4, 7, 8, 2**40])
    assert lm.levels(counts).tolist() == [int(c).bit_length() for c in counts]
    keys = np.array([0, 1, 2**48 - 1, 2**40 + 17], dtype=np.uint64)
    assert lm._unpacked(lm._packed(keys)).tolist() == keys.tolist()


def test_odd_tables(spark):
    docs = samples.empty(spark)
    assert lm.scored(with_fold(docs)).collect() == []
    rows = [(i, "only held out") for i in range(200) if out(i)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = lm.scored(with_fold(docs)).collect()
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in got} == {(0, 0, 0.0, 0.0)}
    odd = samples.odd_rows(spark)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    same(lm.scored(with_fold(odd), EXACT).collect(), plain(rows, 3.0))


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    got = queries.QUERIES["op13_lm_scoring"](spark, folder).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    expected = {r[0]: r for r in plain(rows, lm.Settings().prior)}
    assert len(got) == len(rows)
    for r in got:
        want = expected[r.doc_id]
        assert tuple(r)[:5] == want[:5] and r.base_score == pytest.approx(want[5], rel=1e-9)
        assert r.score >= want[6] - 1e-6  # a false hit can only raise a count
    assert sum(r.score for r in got) == pytest.approx(sum(r[6] for r in expected.values()), rel=0.02)
    unseen = [r for r in got if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)

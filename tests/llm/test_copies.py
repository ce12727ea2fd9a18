"""Exact and near copies against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.llm import exact_dedup, ngram_join
from tidegate.llm.common import components
from tidegate.llm.shingles import shingle_sets

from . import samples


def normal(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def expected_groups(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[normal(r.text)].append(r.doc_id)
    out = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        for k, i in enumerate(sorted(ids, key=lambda i: (i is None, i or 0))):
            out[i, keep, len(ids), k == 0, sha] += 1
    return out


@pytest.mark.parametrize("budget", [4000, exact_dedup.TABLE_BYTES])
def test_exact_groups(spark, budget):
    for frame in (samples.documents(spark, extra=True), samples.odd_rows(spark)):
        found = Counter(tuple(r) for r in exact_dedup.exact_groups(frame, table_bytes=budget).collect())
        assert found == expected_groups(frame.collect())


def test_no_documents(spark):
    assert exact_dedup.exact_groups(samples.empty(spark)).count() == 0
    assert ngram_join.near_groups(samples.empty(spark)).count() == 0
    assert ngram_join.one_of_each(samples.empty(spark)).count() == 0


def test_content_table_compares_contents():
    table = exact_dedup.ContentTable(10**6)
    words = [f"text {i}" for i in range(3000)]
    for w in words:
        slot, there = table.place(7, w) if len(w) < 7 else table.place(hash(w) & (2**63 - 1), w)
        assert not there
        table.add(slot, 7 if len(w) < 7 else hash(w) & (2**63 - 1), w)
    for i, w in enumerate(words):
        slot, there = table.place(7 if len(w) < 7 else hash(w) & (2**63 - 1), w)
        assert there and table.entry(slot) == i


def test_without_copies_keeps_all_columns(spark):
    frame = samples.documents(spark, extra=True)
    kept = exact_dedup.without_copies(frame)
    assert kept.dtypes == frame.dtypes
    assert kept.count() == len({normal(r.text) for r in frame.collect()})
    assert exact_dedup.without_copies(samples.odd_rows(spark)).count() == 4


def shingles(text):
    words = re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (text or "").lower())
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def expected_links(rows):
    sets = [shingles(r.text) for r in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[top(a)] = top(b)
    groups = defaultdict(list)
    for x in range(len(rows)):
        groups[top(x)].append(rows[x].doc_id)
    least = {k: min([i for i in ids if i is not None], default=None) for k, ids in groups.items()}
    return Counter((r.doc_id, least[top(x)], links[x]) for x, r in enumerate(rows)), len(groups)


@pytest.mark.parametrize("block", [2, ngram_join.BLOCK])
def test_near_groups(spark, block):
    for frame in (samples.documents(spark, extra=True), samples.odd_rows(spark)):
        found = ngram_join.near_groups(frame, block=block).collect()
        expected, classes = expected_links(frame.collect())
        assert Counter((r.doc_id, r.class_id, r.n_links) for r in found) == expected
        assert sum(r.kept for r in found) == classes
    kept = ngram_join.one_of_each(samples.documents(spark, extra=True))
    frame = samples.documents(spark, extra=True)
    assert kept.dtypes == frame.dtypes and kept.count() == expected_links(frame.collect())[1]


def test_shingle_hashes_are_those_of_the_word_runs():
    rows = samples.texts(5)
    for text, found in zip(rows, shingle_sets(rows)):
        assert len(found) == len(shingles(text))
    a, b = "one two three four five six", "ONE  two, three FOUR five; seven"
    x, y = shingle_sets([a, b])
    assert len(np.intersect1d(x, y)) == len(shingles(a) & shingles(b)) == 1


def test_pruning_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(3)
    lost = 0
    for _ in range(300):
        first = rng.integers(0, 65536, (1, ngram_join.VALUES), dtype=np.uint16)
        second = np.where(rng.random(first.shape) < 0.8, first, first ^ 1).astype(np.uint16)
        lost += not len(ngram_join.surviving(first, second, False)[0])
        apart = np.where(rng.random(first.shape) < 0.3, first, first ^ 1).astype(np.uint16)
        assert not len(ngram_join.surviving(first, apart, False)[0])
    assert not lost


def test_components(spark):
    import random

    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(60)]
    edges += [(5, 5), (None, 3), (500, 400), (400, 300)]
    frame = spark.createDataFrame(edges, "a bigint, b bigint")
    found = {r.v: r.root for r in components(frame).collect()}
    top = {}

    def root(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            top[root(max(root(a), root(b)))] = min(root(a), root(b))
    groups = defaultdict(set)
    for v in top:
        groups[root(v)].add(v)
    again = defaultdict(set)
    for v, r in found.items():
        again[r].add(v)
    assert sorted(map(sorted, again.values())) == sorted(map(sorted, groups.values()))
    assert components(frame.where(F.lit(False))).count() == 0

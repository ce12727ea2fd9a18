"""Fuzzy lines and near vectors against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from tidegate.llm import line_dedup, vectors
from tidegate.llm.shingles import word_hashes

from . import samples


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(600):
        a, b = ("".join(rng.choice("abé ") for _ in range(rng.randint(0, 80))) for _ in range(2))
        assert line_dedup.edit_distance(a, b) == levenshtein(a, b)


def test_alike():
    rng = random.Random(2)
    for _ in range(600):
        a = "".join(rng.choice("ab ") for _ in range(rng.randint(0, 30)))
        b = list(a)
        for _ in range(rng.randint(0, 9)):
            b[rng.randrange(len(b) + 1) :][:1] = []
            b.insert(rng.randrange(len(b) + 1), rng.choice("ab "))
        b = "".join(b)
        wanted = levenshtein(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9
        assert line_dedup.alike(a, b, 0.8) == wanted


def plain_simhash(line):
    hashes = {int(h) for h in word_hashes([line])[0]}
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def line_texts():
    rng = random.Random(7)
    base = [" ".join(rng.choice(samples.WORDS) + rng.choice(samples.WORDS) for _ in range(40)) for _ in range(6)]
    rows = []
    for _ in range(40):
        lines = []
        for _ in range(rng.randint(1, 5)):
            words = rng.choice(base).split(" ")
            if rng.random() < 0.6:
                words[rng.randrange(len(words))] = rng.choice(samples.WORDS)
            lines.append((" ".join(words)).title() if rng.random() < 0.3 else ", ".join(words))
        rows.append("\n".join(lines))
    long = " ".join(rng.choice(samples.WORDS) for _ in range(700))
    return rows + [None, "", "\n\n", "...\n...", "a\na\nA!", rows[0], rows[0], long, long + " end"]


@pytest.mark.parametrize("block", [3, line_dedup.BLOCK])
def test_line_groups(spark, block):
    frame = samples.documents(spark, line_texts(), extra=True)
    rows = line_dedup.line_groups(frame, block=block).collect()
    lines = []
    for r in sorted(frame.collect(), key=lambda r: r.doc_id):
        lines += [(r.doc_id, i, line_dedup.normal(x)) for i, x in enumerate((r.text or "").split("\n"))]
    first = {}
    for doc, i, line in lines:
        first.setdefault(line, (doc, i))
    distinct = [x for x in first if x]
    hashes = [plain_simhash(x) for x in distinct]
    root = list(range(len(distinct)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(distinct)):
        for b in range(a):
            longer = max(len(distinct[a]), len(distinct[b]))
            if (hashes[a] ^ hashes[b]).bit_count() <= 3 and levenshtein(distinct[a], distinct[b]) <= 0.2 * longer + 1e-9:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)  # distinct lines are in order of their first place
    assert sum(top(x) != x for x in range(len(distinct))) > 10
    number = {x: i for i, x in enumerate(distinct)}
    wanted = {(d, i): first[distinct[top(number[x])]] if x else (d, i) for d, i, x in lines}
    assert {(r.doc_id, r.line_no): (r.first_doc, r.first_line) for r in rows} == wanted
    assert len(rows) == len(lines)
    assert all(r.kept == (wanted[r.doc_id, r.line_no] == (r.doc_id, r.line_no)) for r in rows)


def test_texts_without_repeated_lines(spark):
    rows = ["one two\nthree four", "Three  four!\nfive", None, "", "x\nx\nx"]
    clean = line_dedup.without_repeated_lines(samples.documents(spark, rows, extra=True))
    assert {r.doc_id: r.text for r in clean.collect()} == {0: rows[0], 1: "five", 2: None, 3: "", 4: "x"}
    assert line_dedup.line_groups(samples.empty(spark)).count() == 0
    odd = line_dedup.line_groups(samples.odd_rows(spark)).collect()
    assert len(odd) == 8 and sum(r.kept for r in odd) == 5  # three texts, and two without words


def vector_rows():
    rng = np.random.default_rng(4)
    rows = []
    for label in (1, 2):
        for _ in range(12):
            base = rng.normal(size=24)
            rows += [(len(rows) + k, (base + k * 0.06 * rng.normal(size=24)).tolist(), label) for k in range(4)]
    rows += [(200 + k, rows[0][1], 1) for k in range(5)] + [(210, rows[0][1], 2), (211, [2.5 * x for x in rows[0][1]], 1)]
    rows += [(220, None, 1), (221, [], 1), (222, [0.0] * 24, 1), (223, [float("nan")] * 24, 1), (224, [1.0, None], 1)]
    rows += [(225, [float("inf"), 1.0], 1), (226, rows[0][1], None), (None, rows[0][1], 1), (3, rows[3][1], 1)]
    rows += [(230, [1.0], 1), (231, [2.0], 1), (232, [-1.0], 1), (233, [1e300, 1e300], 1), (234, [3.0, 3.0], 1)]
    return rows


@pytest.mark.parametrize("block", [4, vectors.BLOCK])
def test_near_vectors(spark, block):
    rows = vector_rows()
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(3)
    found = vectors.near_vectors(frame.selectExpr("*", "'own' as uid", "'own' as root"), block=block).collect()
    units = []
    for _, v, label in rows:
        fine = label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        units.append(vectors.unit(np.array([v], dtype=float))[0] if fine else None)
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if units[a] is None or units[b] is None or rows[a][2] != rows[b][2] or len(units[a]) != len(units[b]):
                continue
            if units[a] @ units[b] >= 0.98:
                links[a] += 1
                links[b] += 1
                root[top(a)] = top(b)
    least = {}
    for x, (name, _, _) in enumerate(rows):
        if name is not None:
            least[top(x)] = min(least.get(top(x), name), name)
    wanted = Counter((r[0], links[x], least.get(top(x)), r[0] == least.get(top(x))) for x, r in enumerate(rows))
    assert sum(links) > 60
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in found) == wanted


def test_no_vectors(spark):
    frame = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert vectors.near_vectors(frame).count() == 0


def test_hadamard_is_orthogonal():
    turned = vectors.hadamard(np.eye(8))
    assert np.array_equal(turned @ turned.T, 8 * np.eye(8))

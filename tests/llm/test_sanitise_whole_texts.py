"""Disclosing terms are counted and marked in whole texts, not only close to an entity."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from tidegate.llm import sanitise


def test_terms_far_from_their_entity(spark):
    between = "common words stand here and there " * 12  # far more than 80 characters
    filler = [(i, f"{between} number{i}") for i in range(10, 60)]
    rows = [(1, f"zorblat {between} jo@mail.org"), (2, f"jo@mail.org {between} Zorblat, zorblat"),
            (3, f"quux jo@mail.org {between} quux"), (4, f"quux {between} here jo@mail.org"), *filler]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    clean = {r.doc_id: r.text for r in sanitise.sanitised(frame, generalise=0.5, remove=0.7).collect()}
    for i in (1, 2, 3, 4):
        assert not re.search("zorblat|quux|jo@", clean[i], re.I) and "common" in clean[i]
    assert clean[12] == filler[2][1]


def test_counts_and_places_against_plain_python(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(30)]
    rows = []
    for i in range(80):
        words = [rng.choice(vocabulary) + rng.choice(["", ",", "."]) for _ in range(rng.randint(1, 40))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["p1@w5.org", "p2@m.org", "10.0.0.1", "x10.0.0.2w7"]))
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = sanitise.find_personal(frame, support=2, remove=0.3, generalise=0.1).collect()
    holds, both, every, places = {}, {}, {}, {}
    for r in found:
        text = dict(rows)[r.doc_id]
        words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]+", text)]
        free = [w for w in words if not any(b.start < w[1] and w[0] < b.end for b in r.base)]
        entities = {(b.kind, b.value) for b in r.base}
        places[r.doc_id] = free, entities
        for t in {w[2] for w in words}:
            every[t] = every.get(t, 0) + 1
        for c in entities:
            holds[c] = holds.get(c, 0) + 1
            for t in {w[2] for w in free}:
                both[c, t] = both.get((c, t), 0) + 1
    judged = {}
    for (c, t), n in both.items():
        share = np.log(n * len(rows) / (every[t] * holds[c])) / np.log(len(rows) / holds[c])
        if n >= 2 and share >= 0.1:
            judged[c, t] = share
    total = 0
    for r in found:
        free, entities = places[r.doc_id]
        wanted = set()
        for start, end, t in free:
            top = max((judged[c, t] for c in entities if (c, t) in judged), default=None)
            if top is not None:
                wanted.add(("removed" if top >= 0.3 else "generalised", start, end, t))
        assert {(s.kind, s.start, s.end, s.value) for s in r.spans if s.rank > 3} == wanted
        total += len(wanted)
    assert total > 20


def test_words_cut_by_spans(spark):
    frame = spark.createDataFrame([(0, "ab 10.0.0.1x cd"), (1, "x10.0.0.1 y"), (2, "a@b.cö é a@b.c"), (3, "p@q.r")], "id int, text string")
    rows = frame.select("id", sanitise._outside(F.col("text"), sanitise.base_spans(F.col("text"))).alias("w")).collect()
    found = {r.id: sorted(r.w) for r in rows}
    assert found[0] == ["ab", "cd"] and found[1] == ["y"] and found[3] == []
    assert "é" in found[2] and "ö" not in found[2]

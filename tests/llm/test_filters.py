"""Toxicity, personal data and licences against brute force and held-out labels."""

import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from tidegate.llm import licenses, sanitise, toxicity

from . import samples

# ---------------------------------------------------------------- toxicity


def bags(count, seed):
    """Texts of a few sentences; a toxic one holds one bad sentence."""
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        sentences = [" ".join(rng.choice(samples.WORDS) + rng.choice(samples.WORDS) for _ in range(6)) for _ in range(rng.randint(1, 6))]
        bad = rng.random() < 0.3
        if bad:
            sentences[rng.randrange(len(sentences))] += rng.choice([" vilest thing", " rottener", " rottenish lot"])
        rows.append((i, ". ".join(sentences) + ".", int(bad)))
    return rows


def test_bags_learn_from_document_labels_and_locate_sentences(spark):
    rows = bags(500, 1)
    documents = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    model = toxicity.train(documents, labels, sample=300)
    found = {r.doc_id: r for r in toxicity.scored(documents, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    right = [found[i].predicted == y for i, _, y in held]
    assert len(held) > 50 and np.mean(right) > 0.95
    for i, text, y in held:
        if y and found[i].predicted:
            worst = found[i].offending[0]
            assert "vilest" in text[worst.start : worst.end] or "rotten" in text[worst.start : worst.end]
    assert toxicity.without_toxic(documents, model).count() == sum(r.predicted == 0 for r in found.values())


def test_labels_of_the_held_out_fold_are_not_learned(spark):
    rows = bags(120, 2)
    documents = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    turned = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(documents, labels), toxicity.train(documents, turned)
    assert a.bias == b.bias and a.weights == b.weights and a.weights


def test_scores_of_odd_texts(spark):
    some = toxicity.fit(["good day. vile one."] * 6 + ["good day. fine one."] * 6, [1] * 6 + [0] * 6)
    for frame in (samples.odd_rows(spark), samples.documents(spark, extra=True), samples.empty(spark)):
        found = toxicity.scored(frame, some).collect()
        assert len(found) == frame.count() and all(0 <= r.score <= 1 for r in found)
        assert toxicity.without_toxic(frame, some).dtypes == frame.dtypes
    documents = samples.documents(spark)
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r.score for r in toxicity.scored(documents, toxicity.train(documents, none)).collect()} == {0.0}
    ones = spark.createDataFrame([(2, 1), (3, 1), (None, 0), (4, None), (99999, 0)], "doc_id bigint, toxic int")
    assert {r.score for r in toxicity.scored(documents, toxicity.train(documents, ones)).collect()} == {1.0}


def test_words_weigh_what_their_features_do():
    rng = random.Random(9)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(300)]
    grams = sorted({g for w in words for g in toxicity.features(w)})
    model = toxicity.Model(0.0, {g: rng.random() for g in rng.sample(grams, 200)})
    for w in words:
        assert np.isclose(model._word(w), sum(model.weights.get(g, 0.0) for g in toxicity.features(w)))


def test_score_is_noisy_or_of_sentences():
    model = toxicity.fit(["good day. vile one."] * 6 + ["good day. fine one."] * 6, [1] * 6 + [0] * 6)
    text = "fine day! vile one\n\nwhat...good"
    logits = [model.sentence_logits(s)[0] for s in ("fine day", "vile one", "what", "good")]
    assert np.allclose(model.sentence_logits(text), logits)
    assert np.isclose(model.score(text), 1 - np.prod(1 - 1 / (1 + np.exp(-np.array(logits)))))
    assert model.sentence_logits("").tolist() == [model.bias] == model.sentence_logits("..\n").tolist()


# ---------------------------------------------------------------- personal data


def luhn(digits):
    total = 0
    for place, c in enumerate(reversed(digits)):
        n = int(c) * (1 + place % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def plain_spans(text):
    """The patterns as stated, leftmost and non-overlapping."""
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out))


def test_patterns(spark):
    rng = random.Random(5)
    parts = ["a", "é", "🙂", "@", "@x.co", ".", "1", "22", "255", "256", "-", " ", "  ", "+", "+1 (23", "4111111111111111",
             "4111 1111-1111 1111", "(", ")", "_", "%", "\n", "1.2.3.4", "0001.2.3.04", ".5", "378282246310005", "00000000000000"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(6000)]
    texts += [None, "", "1" * 20_000, "a" * 20_000, "1 " * 20_000, "1." * 8_000, "a@b.c " * 200]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    spans = sanitise.joined(sanitise.base_spans(F.coalesce("text", F.lit(""))))
    found = frame.select("doc_id", spans.alias("s")).collect()
    assert sum(bool(r.s) for r in found) > 500
    assert [(texts[r.doc_id], r.s) for r in found] == [(texts[r.doc_id], plain_spans(texts[r.doc_id])) for r in found]


def test_disclosing_terms(spark):
    filler = [(i, f"common words stand here number{i} and there") for i in range(10, 40)]
    rows = [(1, "common the zorblat writes jo@mail.org here"), (2, "again zorblat, ask jo@mail.org here"),
            (3, "some other common ann@mail.org here"), (4, None), (5, ""), *filler]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("uid", F.lit("own"))
    found = {r.doc_id: [(s.kind, s.value) for s in r.spans] for r in sanitise.find_personal(frame).collect()}
    assert found[1] == [("removed", "zorblat"), ("email", "jo@mail.org")]
    assert found[2] == [("removed", "zorblat"), ("email", "jo@mail.org")]
    assert found[3] == [("email", "ann@mail.org")]  # seen with its neighbours once
    assert found[4] == found[5] == [] and len(found) == len(rows)
    clean = {r.doc_id: r.text for r in sanitise.sanitised(frame).collect()}
    assert clean[1] == "common the  writes [EMAIL] here" and clean[4] == "" and clean[12] == filler[2][1]


def test_disclosure_follows_the_counts(spark):
    rng = random.Random(8)
    rows = []
    for i in range(60):
        words = [rng.choice(samples.WORDS[:6]) for _ in range(rng.randint(1, 5))]
        if rng.random() < 0.5:
            words.insert(rng.randrange(len(words) + 1), f"p{rng.randrange(3)}@m.org")
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = sanitise.find_personal(frame, support=2, remove=0.3, generalise=0.1).collect()
    near, holds, terms = {}, {}, {}
    for i, text in rows:
        words = text.split(" ")
        mails = {w for w in words if "@" in w}
        for t in {x for w in words for x in re.findall(r"\w+", w)}:
            terms[t] = terms.get(t, 0) + 1
        for c in mails:
            holds[c] = holds.get(c, 0) + 1
            for w in set(words) - mails:
                near[c, w] = near.get((c, w), 0) + 1
    kinds = {}
    for (c, w), n in near.items():
        share = np.log(n * 60 / (terms[w] * holds[c])) / np.log(60 / holds[c])
        if n >= 2 and share >= 0.1:
            kinds[c, w] = share
    for r in found:
        words = rows[r.doc_id][1].split(" ")
        for w in set(words):
            top = max((kinds[c, w] for c in words if (c, w) in kinds), default=None)
            got = {s.kind for s in r.spans if s.value == w and s.rank > 3}
            assert got == (set() if top is None else {"removed" if top >= 0.3 else "generalised"})


def test_personal_data_of_odd_tables(spark):
    for frame in (samples.odd_rows(spark), samples.documents(spark, extra=True), samples.empty(spark)):
        assert sanitise.find_personal(frame).count() == frame.count()


# ---------------------------------------------------------------- licences


def runs(templates):
    return {t.words[i:j] for t in templates for i in range(len(t.words)) for j in range(i + 1, len(t.words) + 1)}


def test_matching_statistics():
    own, templates = licenses.automaton(), licenses.templates()
    known, rng = runs(templates), random.Random(3)
    vocabulary = [*own.ids, b"foo", b"bar"]
    for _ in range(600):
        words: list[bytes] = []
        while len(words) < rng.randint(1, 50):
            if rng.random() < 0.6:
                t = rng.choice(templates).words
                i = rng.randrange(len(t))
                words += t[i : i + rng.randint(1, 9)]
            else:
                words.append(rng.choice(vocabulary))
        places, matches = own.stream(words)
        phrases = [(n, t.words) for n, t in enumerate(templates) if t.phrase]
        assert sorted(places) == sorted(
            (i, n) for n, p in phrases for i in range(len(words)) if tuple(words[i : i + len(p)]) == p
        )
        longest = [max([0, *(i + 1 - s for s in range(i + 1) if tuple(words[s : i + 1]) in known)]) for i in range(len(words))]
        ends = [i for i in range(len(words)) if i + 1 == len(words) or longest[i + 1] <= longest[i]]
        wanted = [(i + 1 - longest[i], i + 1) for i in ends if longest[i] >= licenses.LEAST_RUN]
        assert [(a, b) for a, b, _ in matches] == wanted


def test_chains_cover_templates():
    text = "x Permission is hereby granted, free of any charge, to any person obtaining a copy of the software and associated documentation files (the Software), to deal in the Software without restriction y"
    found = licenses.scan_text(text)
    assert found["labels"] == "mit" and found["base_labels"] == "" and found["n_base"] == 0
    assert [(s["start"], s["end"]) for s in found["spans"]] == [(1, 31)] and 0.7 < found["score"] < 1
    assert licenses.scan_text("Licensed under CC BY-NC 4.0.")["labels"] == "cc-by,cc-by-nc-4.0"
    assert licenses.scan_text("MIT license, mit LICENSE")["n_base"] == 2
    assert licenses.scan_text(None)["n_words"] == 0 and licenses.scan_text(None)["score"] == 0.0


def test_words_and_tables(spark):
    assert licenses.words_of("ÀB c-d_e1 ½{x}\x7f") == ["Àb".encode(), b"c", b"d", b"e1", "½".encode(), b"x"]
    for frame in (samples.odd_rows(spark), samples.documents(spark, extra=True), samples.empty(spark)):
        assert licenses.scan(frame).count() == frame.count()

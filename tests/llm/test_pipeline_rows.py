"""What each stage of the corpus pipeline keeps, against plain Python, and run() as a whole."""

import random
import re

import corpus_pipeline
from tidegate.llm import mixing, packing
from tidegate.llm.queries import TOKENIZER

from . import samples


def table_of_texts():
    """doc_id, text, lang, source, n_chars, and which of them are toxic."""
    rng = random.Random(5)

    def prose(words):
        return " ".join(rng.choice(samples.WORDS) + rng.choice(samples.WORDS) for _ in range(words))

    rows, toxic = [], {}
    for _ in range(260):
        bad = rng.random() < 0.3
        text = ". ".join(prose(8) for _ in range(rng.randint(3, 7))) + "."
        rows.append(text + " You vilest rottener thing." if bad else text)
        toxic[len(rows) - 1] = int(bad)
    clean = [i for i, bad in toxic.items() if not bad]
    for i in clean[:20]:
        rows.append(rows[i].replace(" ", "  "))  # an exact copy but for white space
    for i in clean[20:40]:
        rows.append(rows[i] + " more")  # a near copy
    rows += [None, "", "one"]
    toxic |= {i: 0 for i in range(260, len(rows))}
    return [(i, t, "en" if i % 3 else "fr", f"s{i % 2}", len(t or "")) for i, t in enumerate(rows)], toxic


def shingles(text):
    words = re.findall(r"\w+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stages_keep_the_right_rows(spark, tmp_path):
    rows, toxic = table_of_texts()
    texts = {r[0]: r[1] for r in rows}
    spark.createDataFrame(rows, samples.DOCUMENTS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1 - y, y) for i, y in toxic.items()], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")

    wanted = {i for i in texts if not toxic[i]}
    steps = [wanted]
    first = {}
    for i in sorted(wanted):
        first.setdefault(re.sub(r"[ \t-\r]+", " ", texts[i] or ""), i)
    steps.append(set(first.values()))
    sets, root = {i: shingles(texts[i]) for i in steps[1]}, {i: i for i in steps[1]}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if b < a and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    steps.append({i for i in root if top(i) == i})
    assert len(steps[0]) - len(steps[1]) >= 20 and len(steps[1]) - len(steps[2]) >= 15

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, stage), ids in zip(corpus_pipeline.STAGES, steps):
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), "stage")
        found = docs.collect()
        assert sorted(r.doc_id for r in found) == sorted(ids), name
        assert all(r.text == texts[r.doc_id] for r in found), name
    drawn = {r.doc_id for r in mixing.mixed(docs).where("sampled").collect()}
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, str(tmp_path))
    assert {r.doc_id for r in mixed.collect()} == drawn and drawn < steps[2]

    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == drawn
    assert len(pieces) == packing.pack_documents(mixed, TOKENIZER, with_ids=True).count()

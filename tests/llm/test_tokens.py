"""Token files and packing against the tokenizer itself."""

import glob
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from tidegate.llm import packing, token_files
from tidegate.llm.tokenizer import Encoder

from . import samples

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    tokenizer = tokenizers.Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return lambda t: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")


def test_parts_give_the_ids_of_whole_texts(reference):
    import random

    rng = random.Random(4)
    marks = ["a", "B", "é", "ß", " ", "  ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "1", "23", "!", ".",
             "?'s", "'ll", "日本", "​", "᠎", "🙂", "-", "\x00", "﻿", "́", "<|endoftext|>"]
    coder = Encoder(PATH, entries=500)  # small, so that parts are forgotten and learned again
    found = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    for at in range(0, len(found), 50):
        for text, ids in zip(found[at : at + 50], coder.encode_all(found[at : at + 50])):
            assert np.frombuffer(ids, "<u4").tolist() == reference(text).tolist(), repr(text)


def test_long_texts_are_cut_between_parts(reference, monkeypatch):
    import random

    rng = random.Random(5)
    monkeypatch.setattr("tidegate.llm.tokenizer.STRETCH", 16)
    coder = Encoder(PATH, entries=50)
    words = ["an", "Été", "groß", "x" * 40, "it's", "end.", "wow!!", "don't'", "a1", "{b}", "_c_", "\n", "\nNew", "\n\nTwo", "  ", "\r\nL"]
    for _ in range(600):
        text = "".join(rng.choice(["", " ", " ", "\n", "\t"]) + rng.choice(words) for _ in range(rng.randint(1, 80)))
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == reference(text).tolist(), repr(text)
        assert all(len(part) <= 64 for part in coder.memo) and len(coder.memo) <= 50 + 40


def check_files(spark, documents, path, reference):
    token_files.write_tokens(documents, path, PATH, ("lang",))
    rows = token_files.with_crc32(token_files.read_tokens(spark, path)).orderBy("start").collect()
    given = documents.select("doc_id", "text").collect()
    assert len(rows) == len(given)
    wanted = sorted((g.doc_id is not None, g.doc_id or 0, zlib.crc32(reference(g.text).tobytes())) for g in given)
    found = sorted((r.doc_id is not None, r.doc_id or 0, r.ids_crc32) for r in rows)
    assert wanted == found
    order = [(r.doc_id is not None, r.doc_id or 0) for r in rows]
    assert order == sorted(order)
    at = 0
    for r in rows:
        assert (r.start, r.n_ids) == (at, r.n_tokens)
        at += r.n_tokens


def test_token_files(spark, tmp_path, reference):
    check_files(spark, samples.documents(spark, extra=True), str(tmp_path / "a"), reference)
    check_files(spark, samples.odd_rows(spark), str(tmp_path / "b"), reference)
    check_files(spark, samples.empty(spark), str(tmp_path / "c"), reference)


def test_metadata_may_not_clash(spark, tmp_path):
    frame = samples.documents(spark).withColumn("ids", F.lit(1))
    with pytest.raises(ValueError):
        token_files.write_tokens(frame, str(tmp_path / "x"), PATH, ("ids",))


def test_selective_reads(spark, tmp_path):
    path = str(tmp_path / "tokens")
    token_files.write_tokens(samples.documents(spark), path, PATH, ("lang", "source"))
    for name in glob.glob(path + "/*.parquet"):
        group = pq.ParquetFile(name).metadata.row_group(0)
        columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
        assert all(c.has_column_index and c.has_offset_index for c in columns.values())
        assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings
        assert "DELTA_BINARY_PACKED" in columns["start_in_part"].encodings
    few = token_files.read_tokens(spark, path, F.col("doc_id") == 7, ("doc_id", "n_tokens"))
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in plan and "ids" not in plan.split("ReadSchema")[1]
    assert few.count() == 1


def check_pieces(documents, reference, length=1024, **settings):
    pieces = packing.pack_documents(documents, PATH, length, with_ids=True, **settings).collect()
    wanted = defaultdict(int)
    for row in documents.collect():
        wanted[row.doc_id, zlib.crc32(reference(row.text).tobytes())] += 1
    sequences, total = defaultdict(list), 0
    by_document = defaultdict(list)
    for p in pieces:
        assert p.length == len(p.ids) and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        sequences[p.sequence_id].append(p)
        by_document[p.doc_id, p.doc_tokens].append(p)
        total += p.length
    for found in sequences.values():
        at = 0
        for p in sorted(found, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length and at & (at - 1) == 0  # no sequence is padded
    assert total == sum(len(reference(r.text)) for r in documents.collect())
    return wanted, by_document


def test_packing(spark, reference):
    documents = samples.documents(spark, extra=True)
    wanted, found = check_pieces(documents, reference)
    whole = defaultdict(int)
    for (name, tokens), pieces in found.items():
        pieces.sort(key=lambda p: p.start)
        ids = sum((p.ids for p in pieces), [])
        assert [p.start for p in pieces] == np.cumsum([0] + [p.length for p in pieces])[:-1].tolist()
        assert len(ids) == tokens
        whole[name, zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert whole == wanted
    check_pieces(documents, reference, 64, group_tokens=500)
    check_pieces(samples.odd_rows(spark), reference)
    assert packing.pack_documents(samples.empty(spark), PATH).count() == 0


def test_pack_takes_the_cheapest_sequence_with_room():
    import random

    rng = random.Random(2)
    for _ in range(200):
        lengths = [rng.randint(1, 90) for _ in range(rng.randint(1, 30))]
        rooms = packing.rooms_for(sum(lengths), 32)
        left, spent = list(rooms), [0.0] * len(rooms)
        taken = []
        for document, start, n, number, offset in packing.pack(lengths, 32):
            assert offset == rooms[number] - left[number] and n <= left[number]
            roomy = [s for s, r in enumerate(left) if r >= n]
            whole = min(roomy, key=lambda s: (spent[s], s))
            cut = left[number] == max(left) == n
            assert number == whole or cut
            left[number] -= n
            spent[number] += packing.cost(n)
            taken.append((document, start, n))
        assert not any(left)
        taken.sort()
        for document, tokens in enumerate(lengths):
            at = 0
            for d, start, n in taken:
                if d == document:
                    assert start == at
                    at += n
            assert at == tokens

"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

A count c is stored as its level 1 + floor(log2 c): the filter holds the pairs (n-gram, 1) to
(n-gram, level), and a count is read back by probing levels until one is absent.  What is
stored is never missed; a false hit can only raise a count, ever less likely by each level.

    P(w | h) = (c(h w) + prior * P(w)) / (c(h) + prior),   P(w) = (c(w) + 1) / (N + V + 1)

with c(h w) from the filter, at most c(h) and c(w), and exact counts of single tokens.  Over
all tokens P(w) adds up to one, unknown ones included.

Steps: (1) tasks read documents in chunks of `chunk_bytes` of text and store each document's
tokens as numbers of the chunk's own words, and these words once per chunk with their counts;
(2) a window over equal words gives their counts in the whole corpus, so texts and words never
meet in a join per document; (3) a second scan counts pairs of neighbours per chunk, packed
by bucket of their hash; buckets are merged and each builds its own part of the filter;
(4) parts of up to `slice_bytes` in all are broadcast and every chunk is scored with its words'
counts.  The filter grows with the corpus; one that needs more than a slice takes a pass per
slice, each scoring the neighbours that belong to it, and the passes add up.

Defined cases: a null text is empty and has the end token only; a null id is learned from;
repeated ids and texts are rows of their own; a text of any length is one row in one chunk,
read whole; an empty table gives an empty result, and with nothing to learn from every token
has the probability of an unknown one.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidegate.llm.common import stored

PROBE_BITS = 6  # set per stored pair
SCORED = 2**17  # tokens that a task scores at once
CHUNKS = 2  # intended per shuffle partition
KEY_BITS = 48
FOLDS, HELD_OUT = 7, 2

END = b""  # no word is empty
_START_HASH = np.uint64(0x9E3779B97F4A7C15)
_BIT = np.uint64(1)
_CHUNK_SHIFT = 33


@dataclass(frozen=True)
class Settings:
    prior: float = 500.0  # weight of the single-token probability
    bits: int = 12  # of the filter per stored pair
    chunk_bytes: int = 16 << 20  # of text whose words are counted together
    bucket_pairs: int = 2**21  # intended neighbours per part of the filter
    slice_bytes: int = 64 << 20  # of the filter, broadcast at once


def held_out(doc_id: Column) -> Column:
    """Is the crc32 of the id as text 2 modulo 7?  A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


# ------------------------------------------------------------------------ tokens and hashes


class Words(dict):
    """Numbers of words in order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number

    def numbers(self, text: bytes) -> np.ndarray:
        """Lower-cased words (between ASCII white space) and the end token."""
        found = list(map(self.__getitem__, text.lower().split()))
        found.append(self[END])
        return np.array(found, dtype=np.int32)

    def hashes(self) -> np.ndarray:
        """What Spark's xxhash64 gives for the words."""
        return np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in self), dtype=np.uint64, count=len(self))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_hashes(hashes: np.ndarray, tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hash of every token with the one before it; texts begin at `starts`."""
    own = hashes[tokens]
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[starts] = _START_HASH
    return mixed(before * np.uint64(0xD6E8FEB86659FD93) + own)


def bucket_of(pairs: np.ndarray, bits: int) -> np.ndarray:
    return (pairs >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(pairs), dtype=np.int64)


def key_of(pairs: np.ndarray) -> np.ndarray:
    return pairs & np.uint64(2**KEY_BITS - 1)


# ------------------------------------------------------------------------------- the filter


def places(keys: np.ndarray, level: int, words: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Word of the filter and bits in it of (key, level); one word is read per probe."""
    x = mixed(keys + np.uint64(level * int(_START_HASH) % 2**64))
    word = ((x >> np.uint64(32)) * np.asarray(words, dtype=np.uint64)) >> np.uint64(32)
    mask = np.zeros(len(x), dtype=np.uint64)
    for k in range(PROBE_BITS):
        mask |= _BIT << ((x >> np.uint64(6 * k)) & np.uint64(63))
    return word.astype(np.int64), mask


def levels(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 count)."""
    return np.frexp(counts.astype(np.float64))[1]


def level_count(level: np.ndarray) -> np.ndarray:
    """The count a level stands for: the geometric mean of its least and greatest."""
    low = np.exp2(np.maximum(level, 1) - 1.0)
    return np.where(level > 0, np.sqrt(low * (2 * low - 1)), 0.0)


def built(keys: np.ndarray, counts: np.ndarray, bits_each: int) -> np.ndarray:
    """The part of the filter that holds these n-grams."""
    level = levels(counts)
    words = max(1, -(-int(level.sum()) * bits_each // 64))
    bits = np.zeros(words, dtype=np.uint64)
    for j in range(1, int(level.max(initial=0)) + 1):
        word, mask = places(keys[level >= j], j, words)
        np.bitwise_or.at(bits, word, mask)
    return bits


class Slice:
    """Consecutive parts of the filter, from bucket `first` on."""

    def __init__(self, first: int, bits: int, parts: list[np.ndarray]):
        self.first, self.bits = first, bits
        self.sizes = np.array([len(p) for p in parts], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.words = np.concatenate(parts)

    def level(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs belong to this slice, and the levels of those that do."""
        bucket = bucket_of(pairs, self.bits) - self.first
        inside = np.flatnonzero((bucket >= 0) & (bucket < len(self.sizes)))
        bucket, keys = bucket[inside], key_of(pairs[inside])
        level = np.zeros(len(inside), dtype=np.int64)
        alive = np.arange(len(inside))
        while len(alive):
            j = int(level[alive[0]]) + 1
            word, mask = places(keys[alive], j, self.sizes[bucket[alive]])
            held = self.words[self.starts[bucket[alive]] + word]
            alive = alive[(held & mask) == mask]
            level[alive] = j
        return inside, level


# -------------------------------------------------------------------------- reading the corpus


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[Words, list[np.ndarray], list, list[bool]]]:
    """Words, tokens, ids and folds of chunks of documents in the order they are read."""
    words, tokens, ids, folds, size = Words(), [], [], [], 0
    for batch in batches:
        for text, doc_id, out in zip(_texts(batch), batch.column("doc_id"), batch.column("held_out").to_pylist()):
            tokens.append(words.numbers(text))
            ids.append(doc_id)
            folds.append(out)
            size += len(text) + 1
            if size >= most:
                yield words, tokens, ids, folds
                words, tokens, ids, folds, size = Words(), [], [], [], 0
    if tokens:
        yield words, tokens, ids, folds


def tokenised(documents: DataFrame, chunk_bytes: int) -> DataFrame:
    """Rows of kind 0, the words of a chunk, and of kind 1, its documents; `at` is their number.

    `n` counts the word in the chunk's training documents.
    """
    id_type = documents.schema["doc_id"].dataType
    schema = T.StructType(
        [
            T.StructField("chunk", T.LongType()),
            T.StructField("at", T.IntegerType()),
            T.StructField("word", T.BinaryType()),
            T.StructField("n", T.LongType()),
            T.StructField("doc_id", id_type),
            T.StructField("held_out", T.BooleanType()),
            T.StructField("tokens", T.BinaryType()),
            T.StructField("kind", T.IntegerType()),
        ]
    )

    def read(batches):
        arrow = to_arrow_schema(schema)

        def rows(count, **columns):
            arrays = [columns.get(f.name, pa.nulls(count, f.type)) for f in arrow]
            return pa.RecordBatch.from_arrays(arrays, schema=arrow)

        task = TaskContext.get().partitionId() << _CHUNK_SHIFT
        for number, (words, tokens, ids, folds) in enumerate(_chunks(batches, chunk_bytes)):
            learned = [t for t, out in zip(tokens, folds) if not out]
            counts = np.bincount(np.concatenate(learned), minlength=len(words)) if learned else np.zeros(len(words))
            yield rows(
                len(words),
                chunk=pa.array(np.full(len(words), task + number)),
                at=pa.array(np.arange(len(words), dtype=np.int32)),
                word=pa.array(list(words), pa.binary()),
                n=pa.array(counts.astype(np.int64)),
                kind=pa.array(np.zeros(len(words), dtype=np.int32)),
            )
            for start in range(0, len(tokens), 1024):
                part = slice(start, start + 1024)
                count = len(tokens[part])
                yield rows(
                    count,
                    chunk=pa.array(np.full(count, task + number)),
                    at=pa.array(np.arange(start, start + count, dtype=np.int32)),
                    doc_id=pa.array([i.as_py() for i in ids[part]], arrow.field("doc_id").type),
                    held_out=pa.array(folds[part]),
                    tokens=pa.array([t.tobytes() for t in tokens[part]], pa.binary()),
                    kind=pa.array(np.ones(count, dtype=np.int32)),
                )

    return stored(documents.mapInArrow(read, schema), "tokenised", "kind")


def _counted_words(chunks: DataFrame) -> DataFrame:
    """Words of each chunk with their count `c` in all training documents; `fresh` marks one
    row per word."""
    over = Window.partitionBy("word")
    words = chunks.where("kind = 0").select("chunk", "at", "word", "n")
    found = words.select(
        "chunk",
        "at",
        F.xxhash64("word").alias("hash"),
        "n",
        F.sum("n").over(over).alias("c"),
        (F.col("chunk") == F.min("chunk").over(over)).alias("fresh"),
    )
    return stored(found, "words")


def pair_counts(documents: DataFrame, bits: int, chunk_bytes: int) -> DataFrame:
    """Pairs of neighbours in training documents, per chunk and bucket: keys that occur once,
    keys that occur more often, and the counts of the latter."""

    def count(batches):
        for words, tokens, _, _ in _chunks(batches, chunk_bytes):
            starts = np.concatenate(([0], np.cumsum([len(t) for t in tokens])[:-1])).astype(np.int64)
            pairs, counts = np.unique(
                pair_hashes(words.hashes(), np.concatenate(tokens), starts), return_counts=True
            )
            bucket = bucket_of(pairs, bits)
            edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            keys = key_of(pairs)
            rows = {"bucket": bucket[edges].tolist(), "once": [], "more": [], "counts": []}
            for start, end in zip(edges, [*edges[1:], len(pairs)]):
                key, number = keys[start:end], counts[start:end]
                rows["once"].append(_packed(key[number == 1]))
                rows["more"].append(_packed(key[number > 1]))
                rows["counts"].append(number[number > 1].astype("<u4").tobytes())
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    schema = pa.schema([("bucket", pa.int64()), ("once", pa.binary()), ("more", pa.binary()), ("counts", pa.binary())])
    learned = documents.where(~F.col("held_out"))
    return learned.mapInArrow(count, "bucket bigint, once binary, more binary, counts binary")


def _packed(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8]).tobytes()


def _unpacked(text: bytes) -> np.ndarray:
    wide = np.zeros((len(text) * 8 // KEY_BITS, 8), dtype=np.uint8)
    wide[:, : KEY_BITS // 8] = np.frombuffer(text, dtype=np.uint8).reshape(len(wide), KEY_BITS // 8)
    return wide.view("<u8").ravel().astype(np.uint64)


def filter_parts(pairs: DataFrame, bits_each: int) -> DataFrame:
    """The filter: one part per bucket, with its number of n-grams."""
    schema = pa.schema([("bucket", pa.int64()), ("ngrams", pa.int64()), ("words", pa.int64()), ("bits", pa.binary())])

    def part(bucket, keys, counts):
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(counts), minlength=len(distinct))
        bits = built(distinct, total, bits_each)
        row = {"bucket": [bucket], "ngrams": [len(distinct)], "words": [len(bits)], "bits": [bits.tobytes()]}
        return pa.RecordBatch.from_pydict(row, schema=schema)

    def merge(batches):
        current, keys, counts = None, [], []
        for batch in batches:
            for bucket, once, more, number in zip(*(batch.column(c).to_pylist() for c in ("bucket", "once", "more", "counts"))):
                if bucket != current and keys:
                    yield part(current, keys, counts)
                    keys, counts = [], []
                current = bucket
                single = _unpacked(once)
                keys += [single, _unpacked(more)]
                counts += [np.ones(len(single)), np.frombuffer(number, dtype="<u4").astype(np.float64)]
        if keys:
            yield part(current, keys, counts)

    arranged = pairs.repartition("bucket").sortWithinPartitions("bucket")
    return stored(arranged.mapInArrow(merge, "bucket bigint, ngrams bigint, words bigint, bits binary"), "filter")


# ----------------------------------------------------------------------------------- scoring


def scored(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Scores of all documents (doc_id, text, held_out boolean), learned from those not held
    out: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    documents = documents.select("doc_id", "text", "held_out")
    chunks = tokenised(documents, settings.chunk_bytes)
    words = _counted_words(chunks)
    train, known, total = words.agg(
        F.coalesce(F.sum("n"), F.lit(0)),
        F.count_if(F.col("fresh") & (F.col("c") > 0)),
        F.count_if(F.col("at") == 0),
    ).first()
    bits = max(0, -(-train // settings.bucket_pairs) - 1).bit_length()
    parts = filter_parts(pair_counts(documents, bits, settings.chunk_bytes), settings.bits)

    rows = words.select("chunk", F.lit(0).alias("kind"), "at", "c", "hash").unionByName(
        chunks.where("kind = 1").select("chunk", "kind", "at", "doc_id", "held_out", "tokens"), allowMissingColumns=True
    )
    spread = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // CHUNKS)
    arranged = rows.repartition(spread, "chunk").sortWithinPartitions("chunk", "kind", "at")
    most = parts.agg(F.max("words")).first()[0] or 1
    step = max(1, settings.slice_bytes // (8 * most))  # parts per slice
    found = None
    for first in range(0, 1 << bits, step):
        part = _slice(parts, first, min(step, (1 << bits) - first), bits)
        own = _scores(arranged, part, train, known, settings.prior, documents.schema["doc_id"])
        found = own if found is None else found.unionAll(own)
    if step < 1 << bits:
        found = found.groupBy("chunk", "at").agg(
            *[F.first(c).alias(c) for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score")],
            F.sum("score").alias("score"),
        )
    return found.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(train).cast("bigint").alias("train_tokens"), "base_score", "score"
    )


def _slice(parts: DataFrame, first: int, count: int, bits: int):
    """A broadcast of the parts of `count` buckets from `first` on, at most a slice's bytes or one part."""
    empty = np.zeros(1, dtype=np.uint64)
    held = {
        r.bucket: np.frombuffer(r.bits, dtype=np.uint64)
        for r in parts.where(F.col("bucket").between(first, first + count - 1)).select("bucket", "bits").collect()
    }
    whole = Slice(first, bits, [held.get(first + k, empty) for k in range(count)])
    return parts.sparkSession.sparkContext.broadcast(whole)


def _scores(arranged: DataFrame, part, train: int, known: int, prior: float, id_field: T.StructField) -> DataFrame:
    schema = T.StructType(
        [
            T.StructField("chunk", T.LongType()),
            T.StructField("at", T.IntegerType()),
            id_field,
            T.StructField("held_out", T.BooleanType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("n_known", T.LongType()),
            T.StructField("base_score", T.DoubleType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    names = schema.fieldNames()
    all_tokens = train + known + 1

    def score(batches):
        ngrams: Slice = part.value
        chunk, counts, hashes = None, [], []
        for batch in batches:
            place = batch.column("chunk").to_numpy()
            kind = batch.column("kind").to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (kind[1:] != kind[:-1]))))
            for start, end in zip(edges, [*edges[1:], len(place)]):
                rows = batch.slice(start, end - start)
                if place[start] != chunk:
                    chunk, counts, hashes = place[start], [], []
                if kind[start] == 0:
                    counts.append(rows.column("c").to_numpy())
                    hashes.append(rows.column("hash").to_numpy().view(np.uint64))
                    continue
                if len(counts) > 1:
                    counts, hashes = [np.concatenate(counts)], [np.concatenate(hashes)]
                for some in _portions(rows):
                    yield result(some, counts[0], hashes[0], ngrams)

    def result(rows, counts, hashes, ngrams):
        texts = [np.frombuffer(t, dtype=np.int32) for t in rows.column("tokens").to_pylist()]
        lengths = np.array([len(t) for t in texts])
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        tokens = np.concatenate(texts)
        c = counts[tokens]
        before = np.empty_like(c)
        before[1:] = c[:-1]
        ends = starts + lengths - 1
        before[starts] = c[ends]  # texts begin as often as they end
        alone = (c + 1.0) / all_tokens
        inside, level = ngrams.level(pair_hashes(hashes, tokens, starts))
        together = np.minimum(level_count(level), np.minimum(c[inside], before[inside]))
        terms = np.zeros(len(tokens))
        terms[inside] = np.log10((together + prior * alone[inside]) / (before[inside] + prior))
        arrays = [
            rows.column("chunk"),
            rows.column("at"),
            rows.column("doc_id"),
            rows.column("held_out"),
            pa.array(lengths.astype(np.int64)),
            pa.array(np.add.reduceat((c > 0).astype(np.int64), starts)),
            pa.array(np.add.reduceat(np.log10(alone), starts)),
            pa.array(np.add.reduceat(terms, starts)),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    return arranged.mapInArrow(score, schema)


def _portions(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Documents of about SCORED tokens at a time, one at least."""
    sizes = pc.binary_length(rows.column("tokens")).to_numpy() // 4
    start, held = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if held and held + size > SCORED:
            yield rows.slice(start, k - start)
            start, held = k, 0
        held += size
    yield rows.slice(start)

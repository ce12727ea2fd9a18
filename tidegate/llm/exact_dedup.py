"""Grace hash deduplication of whole texts.

1. Every input split is reduced where it lies: an open-addressing table that compares
   complete contents maps each row to the first row of its split with the same text.  A
   text that fills a third of the table so travels once per split, not once per row.
2. The remaining records are partitioned by a hash to one bucket per task.  A task puts
   its bucket into such a table.  Once the table has reached its budget, contents that are
   not in it are written out as spill files.
3. Spill files are partitioned again by a fresh hash, and so on until a level spills
   nothing.  All records of one content go the same way, since a full table takes no more.

Spill files and results are Parquet in the shared folder, and buckets reach tasks by
Spark's shuffle, so a lost executor costs the tasks it ran.  Only level sizes, two numbers
each, come to the driver.

Edge cases: a null text counts as an empty one.  Rows with equal doc_id are rows of their
own: each gets a row back, and of equal texts with equal smallest doc_id one row stays.
A null doc_id is larger than any other.  An empty table gives no rows; extra columns are
left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import few, fresh, stored

TABLE_BYTES = 48 * 2**20  # contents held by one table
SLICE_ROWS = 256

LOCAL = "uid bigint, doc_id bigint, sha string, head bigint, n bigint, hash bigint, text string, kind int"
RESOLVED = "head bigint, keep_id bigint, keep_uid bigint, n bigint, hash bigint, text string, kind int"


def normalised(text: Column) -> Column:
    """Every run of ASCII white space becomes one space; null becomes the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


class ContentTable:
    """Open addressing with linear probing over 64-bit hashes; contents decide.

    Contents lie in one growing buffer; a slot holds the number of an entry.
    """

    def __init__(self, budget: int):
        self.budget = budget
        self.clear()

    def clear(self) -> None:
        self.slots = np.full(1024, -1, dtype=np.int64)
        self.contents: list[str] = []
        self.hashes: list[int] = []
        self.bytes = 0

    def place(self, key: int, content: str) -> tuple[int, bool]:
        """Slot of the content, or of the free place for it, and whether it is there."""
        mask = len(self.slots) - 1
        slot = (key ^ (key >> 32)) & mask
        while (entry := self.slots[slot]) >= 0:
            if self.hashes[entry] == key and self.contents[entry] == content:
                return int(slot), True
            slot = (slot + 1) & mask
        return int(slot), False

    def entry(self, slot: int) -> int:
        return int(self.slots[slot])

    def has_room(self, content: str) -> bool:
        """One content always fits, so that every level gets on."""
        return not self.contents or self.bytes + len(content) <= self.budget

    def add(self, slot: int, key: int, content: str) -> int:
        entry = len(self.contents)
        self.slots[slot] = entry
        self.contents.append(content)
        self.hashes.append(key)
        self.bytes += len(content)
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return entry

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, dtype=np.int64)
        mask = len(self.slots) - 1
        for entry, key in enumerate(self.hashes):
            slot = (key ^ (key >> 32)) & mask
            while self.slots[slot] >= 0:
                slot = (slot + 1) & mask
            self.slots[slot] = entry


def _lower(a: tuple, b: tuple) -> tuple:
    """Smaller of two (doc_id, uid); null doc_ids are larger than any other."""
    return min(a, b, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], names=[n for n, _ in fields]
    )


def _combine(budget: int):
    """Rows of a split: kind 0 maps a row to its head, kind 1 is a head with its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ContentTable(budget)
        heads: list[list] = []  # uid, count, smallest (doc_id, uid)

        def flushed():
            for at in range(0, len(heads), SLICE_ROWS):
                out = []
                for entry in range(at, min(at + SLICE_ROWS, len(heads))):
                    uid, n, low = heads[entry]
                    text, key = table.contents[entry], table.hashes[entry]
                    out.append((low[1], low[0], None, uid, n, key, text, 1))
                yield _batch(out, LOCAL)
            heads.clear()
            table.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                some = batch.slice(at, SLICE_ROWS)
                out = []
                for uid, doc, sha, key, text in zip(*[some.column(c).to_pylist() for c in ("uid", "doc_id", "sha", "hash", "text")]):
                    slot, there = table.place(key, text)
                    if not there and not table.has_room(text):
                        yield from flushed()
                        slot, _ = table.place(key, text)
                    if there:
                        held = heads[table.entry(slot)]
                        held[1] += 1
                        held[2] = _lower(held[2], (doc, uid))
                    else:
                        table.add(slot, key, text)
                        held = [uid, 1, (doc, uid)]
                        heads.append(held)
                    out.append((uid, doc, sha, held[0], None, None, None, 0))
                if out:
                    yield _batch(out, LOCAL)
        yield from flushed()

    return run


def _resolve(budget: int):
    """Records of a bucket: kind 0 is a decided head, kind 1 goes to the next level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ContentTable(budget)
        full = False
        groups: list[list] = []  # heads, count, smallest (doc_id, uid)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                some = batch.slice(at, SLICE_ROWS)
                spilled = []
                for head, doc, uid, n, key, text in zip(*[some.column(c).to_pylist() for c in ("head", "keep_id", "keep_uid", "n", "hash", "text")]):
                    slot, there = table.place(key, text)
                    if there:
                        group = groups[table.entry(slot)]
                        group[0].append(head)
                        group[1] += n
                        group[2] = _lower(group[2], (doc, uid))
                    elif full or not table.has_room(text):
                        full = True
                        spilled.append((head, doc, uid, n, key, text, 1))
                    else:
                        table.add(slot, key, text)
                        groups.append([[head], n, (doc, uid)])
                if spilled:
                    yield _batch(spilled, RESOLVED)
        table.clear()
        out = []
        for heads, n, (doc, uid) in groups:
            for head in heads:
                out.append((head, doc, uid, n, None, None, 0))
                if len(out) == 4096:
                    yield _batch(out, RESOLVED)
                    out = []
        if out:
            yield _batch(out, RESOLVED)

    return run


def exact_groups(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", **settings) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = documents.select(
        F.monotonically_increasing_id().alias("uid"),
        documents[doc_id].cast("bigint").alias("doc_id"),
        documents[text].alias("text"),
    )
    return _grouped(rows, **settings).drop("uid")


def without_copies(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", **settings) -> DataFrame:
    """The rows of `documents` that stay, with all their columns."""
    uid = fresh(documents, "uid")
    kept = stored(documents.withColumn(uid, F.monotonically_increasing_id()), "numbered")
    rows = kept.select(
        F.col(uid).alias("uid"), kept[doc_id].cast("bigint").alias("doc_id"), kept[text].alias("text")
    )
    gone = stored(_grouped(rows, **settings).where("not kept").select(F.col("uid").alias(uid)), "gone")
    return kept.join(few(gone), uid, "left_anti").select(*documents.columns)


def _grouped(numbered: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    clean = numbered.withColumn("text", normalised(F.col("text")))
    hashed = clean.select("uid", "doc_id", F.sha2("text", 256).alias("sha"), F.xxhash64("text").alias("hash"), "text")
    local = stored(hashed.mapInArrow(_combine(table_bytes), LOCAL), "runs", "kind")

    level, decided = 0, None
    left = local.where("kind = 1").select(
        "head", F.col("doc_id").alias("keep_id"), F.col("uid").alias("keep_uid"), "n", "hash", "text"
    )
    least = int(numbered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        size, records = left.agg(F.sum(F.length("text")), F.count("*")).first()
        if decided is not None and not records:
            break
        buckets = max(least, -(-2 * (size or 0) // table_bytes))
        dealt = left.repartition(buckets, F.xxhash64("hash", F.lit(level)))
        done = stored(dealt.mapInArrow(_resolve(table_bytes), RESOLVED), f"level{level}", "kind")
        mine = done.where("kind = 0").select("head", "keep_id", "keep_uid", F.col("n").alias("group_size"))
        decided = mine if decided is None else decided.unionByName(mine)
        left = done.where("kind = 1").drop("kind")
        level += 1
    rows = local.where("kind = 0").select("uid", "doc_id", "sha", "head")
    return rows.join(decided, "head").select(
        "uid",
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("uid") == F.col("keep_uid")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )

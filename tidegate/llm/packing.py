"""Cost-balanced packing of token sequences.

Attention over a document of n tokens costs about n + n*n / QUADRATIC_AT in units of one
linear token, so a sequence of many short documents is cheaper than one of a long
document.  Within a group of documents, pieces are taken in descending length and each
goes to the sequence of lowest cost so far among those with room for it.  Where no
sequence has room for the whole piece, it is cut to fill the roomiest one.

Every task packs the documents of its own input split, in groups of at most GROUP_TOKENS
ids, while it encodes them: nothing is shuffled, memory is bounded by a group, and a task
that is run again gives the same pieces.  A group of n ids gets n // length full
sequences and, for the rest, one sequence for each power of two in it.  A sequence whose
size is a power of two takes no padding, so with a power of two for `length` none is padded.

Edge cases: a null or empty text is a document of the end id alone; documents longer than
a sequence are cut at its length first; rows with equal doc_id are packed each for itself;
an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.tokenizer import ID_BYTES, encoder

LENGTH = 1024
QUADRATIC_AT = 512  # tokens at which the quadratic part equals the linear one
GROUP_TOKENS = 2**21
SLICE_ROWS = 64
GROUP_BITS = 40  # sequences of one input split are numbered below 2**GROUP_BITS

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def cost(tokens: int) -> float:
    return tokens + tokens * tokens / QUADRATIC_AT


class Bins:
    """Sequences with given room; finds the cheapest with at least so much room left.

    Sequences wait in one heap for each size of room, ordered by cost and number; a tree
    over the sizes holds the cheapest of each range of sizes, so a look-up takes
    log2(length) steps whatever the number of sequences.
    """

    def __init__(self, rooms: list[int]):
        self.size = 1 << max(1, max(rooms, default=1)).bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(self.size)]
        for number, room in enumerate(rooms):
            self.heaps[room].append((0.0, number))
        none = (float("inf"), -1)
        self.tree = [none] * self.size + [min(h, default=none) for h in self.heaps]
        for i in range(self.size - 1, 0, -1):
            self.tree[i] = min(self.tree[2 * i], self.tree[2 * i + 1])

    def _update(self, room: int) -> None:
        heap, tree = self.heaps[room], self.tree
        i = room + self.size
        tree[i] = heap[0] if heap else (float("inf"), -1)
        while i > 1:
            i //= 2
            left, right = tree[2 * i], tree[2 * i + 1]
            best = left if left <= right else right
            if tree[i] == best:
                break
            tree[i] = best

    def take(self, need: int) -> tuple[float, int, int] | None:
        """Cheapest sequence with room for `need`, removed: cost, number, room."""
        best, low, tree = (float("inf"), -1), need + self.size, self.tree
        chosen, high = 0, 2 * self.size
        while low < high:
            if low & 1:
                if tree[low] < best:
                    best, chosen = tree[low], low
                low += 1
            low, high = low // 2, high // 2
        if best[1] < 0:
            return None
        while chosen < self.size:
            chosen = 2 * chosen if tree[2 * chosen] == best else 2 * chosen + 1
        room = chosen - self.size
        heapq.heappop(self.heaps[room])
        self._update(room)
        return best[0], best[1], room

    def put(self, spent: float, number: int, room: int) -> None:
        if room:
            heapq.heappush(self.heaps[room], (spent, number))
            self._update(room)

    def roomiest(self) -> tuple[float, int, int]:
        """Sequence with most room left, removed; the cheapest of those."""
        room = self.size - 1
        while not self.heaps[room]:
            room -= 1
        spent, number = heapq.heappop(self.heaps[room])
        self._update(room)
        return spent, number, room


def rooms_for(total: int, length: int = LENGTH) -> list[int]:
    """Full sequences, then one for each power of two in the rest."""
    rest = total % length
    return [length] * (total // length) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(lengths: list[int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) for documents of these lengths."""
    rooms = rooms_for(sum(lengths), length)
    bins = Bins(rooms)
    waiting = []  # descending length, then document and start
    for document, tokens in enumerate(lengths):
        for start in range(0, tokens, length):
            waiting.append((-min(length, tokens - start), document, start))
    heapq.heapify(waiting)
    pieces = []
    while waiting:
        negative, document, start = heapq.heappop(waiting)
        need = -negative
        found = bins.take(need)
        if found is None:
            found = bins.roomiest()
            heapq.heappush(waiting, (found[2] - need, document, start + found[2]))
            need = found[2]
        spent, number, room = found
        pieces.append((document, start, need, number, rooms[number] - room))
        bins.put(spent + cost(need), number, room - need)
    return pieces


def _coded(coder, batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    for at in range(0, batch.num_rows, SLICE_ROWS):
        some = batch.slice(at, SLICE_ROWS)
        yield from zip(some.column("doc_id").to_pylist(), coder.encode_all(some.column("text").to_pylist()))


def pack_documents(
    documents: DataFrame,
    tokenizer_path: str,
    length: int = LENGTH,
    group_tokens: int = GROUP_TOKENS,
    text: str = "text",
    doc_id: str = "doc_id",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece; `with_ids` adds its token ids as a list."""
    rows = documents.select(
        documents[doc_id].cast("bigint").alias("doc_id"),
        documents[text].alias("text"),
        F.spark_partition_id().alias("split"),
    )

    def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, used, total = encoder(tokenizer_path), 0, 0
        names: list[int] = []
        coded: list[bytes] = []
        for batch in batches:
            split = batch.column("split")[0].as_py() if batch.num_rows else 0
            for name, ids in _coded(coder, batch):
                if names and total + len(ids) // ID_BYTES > group_tokens:
                    yield packed(names, coded, (split << GROUP_BITS) + used)
                    used += -(-total // length) + length.bit_length()
                    names, coded, total = [], [], 0
                names.append(name)
                coded.append(ids)
                total += len(ids) // ID_BYTES
        if names:
            yield packed(names, coded, (split << GROUP_BITS) + used)

    def packed(names: list[int], coded: list[bytes], first: int) -> pa.RecordBatch:
        found = pack([len(ids) // ID_BYTES for ids in coded], length)
        parts = [coded[d][s * ID_BYTES : (s + n) * ID_BYTES] for d, s, n, _, _ in found]
        column = np.array(found, dtype=np.int64).reshape(-1, 5).T
        arrays = [
            pa.array([names[d] for d in column[0]], pa.int64()),
            pa.array(column[1]),
            pa.array(column[2]),
            pa.array([zlib.crc32(p) for p in parts], pa.int64()),
            pa.array([len(coded[d]) // ID_BYTES for d in column[0]], pa.int64()),
            pa.array(first + column[3]),
            pa.array(column[4]),
        ]
        header = [c.split()[0] for c in PIECES.split(", ")]
        if with_ids:
            ends = np.append(0, np.cumsum(column[2]))
            flat = np.frombuffer(b"".join(parts), dtype="<i4")
            arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)))
            header.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names=header)

    return rows.mapInArrow(pieces_of, PIECES + (", ids array<int>" if with_ids else ""))

"""Token-id files: Parquet list columns that can be read in part.

One row per document in ascending doc_id order over the whole folder.  Ids are a list of
32-bit integers with dictionary encoding (a vocabulary of 50,000 fits one dictionary page,
so an id takes 16 bits before compression); the numeric metadata columns carry no
dictionary and are delta encoded.  Row groups and pages have set sizes, and the writer adds page indexes, so a
reader of a few documents, or of metadata only, skips the rest.

Edge cases: null and empty texts are documents of the end id alone.  Null doc_ids come
first.  Rows with equal doc_id are all kept, ordered by their texts' hashes.  An empty
table gives an empty folder that reads back as no rows.  Extra columns of the input are
left out unless named in `metadata`; metadata may not use the names of the file's own columns.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.llm.tokenizer import ID_BYTES, encoder

ROW_GROUP_BYTES = 32 * 2**20
PAGE_BYTES = 256 * 2**10
PAGE_ROWS = 2_000
MOST_BROADCAST = 100_000  # files whose totals, 16 bytes each, are sent to all executors
SLICE_ROWS = 64  # documents encoded between two batches sent back

OWN = ("doc_id", "part", "start_in_part", "n_tokens", "ids")
DELTA = ("doc_id", "part", "start_in_part", "n_tokens")


def write_tokens(
    documents: DataFrame,
    path: str,
    tokenizer_path: str,
    metadata: tuple[str, ...] = (),
    text: str = "text",
    doc_id: str = "doc_id",
) -> None:
    """Encode every whole text and write the files.

    Texts are dealt to ranges of doc_id, as many as the input has partitions, so each
    task writes one run of the order.  Tokens are counted on the way: `start_in_part` is
    the position of a document in its file, and only the files' totals need summing later.
    """
    taken = set(metadata) & set(OWN)
    if taken:
        raise ValueError(f"metadata columns clash with the file's own: {sorted(taken)}")
    rows = documents.select(
        documents[doc_id].cast("bigint").alias("doc_id"),
        documents[text].alias("_text"),
        *[documents[c] for c in metadata],
    )
    parts = max(1, documents.rdd.getNumPartitions())
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions(
        F.asc_nulls_first("doc_id"), F.xxhash64("_text")
    )
    kept = [f for f in rows.schema.fields if f.name in metadata]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *kept]).add("part", "integer")
    schema = schema.add("start_in_part", "long").add("n_tokens", "long").add("ids", T.ArrayType(T.IntegerType()))

    numbered = ordered.withColumn("part", F.spark_partition_id())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, start = encoder(tokenizer_path), 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                some = batch.slice(at, SLICE_ROWS)
                coded = coder.encode_all(some.column("_text").to_pylist())
                counts = np.array([len(c) // ID_BYTES for c in coded], dtype=np.int64)
                ends = np.cumsum(counts)
                ids = pa.array(np.frombuffer(b"".join(coded), dtype="<i4"))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), ids)
                columns = {
                    "doc_id": some.column("doc_id"),
                    **{c: some.column(c) for c in metadata},
                    "part": some.column("part"),
                    "start_in_part": pa.array(start + ends - counts),
                    "n_tokens": pa.array(counts),
                    "ids": lists,
                }
                start += int(ends[-1])
                yield pa.RecordBatch.from_arrays(
                    [columns[f.name] for f in schema.fields], names=schema.names
                )

    writer = numbered.mapInArrow(encode, schema).write
    settings = {
        "compression": "zstd",
        "parquet.block.size": ROW_GROUP_BYTES,
        "parquet.page.size": PAGE_BYTES,
        "parquet.page.row.count.limit": PAGE_ROWS,
        "parquet.writer.version": "PARQUET_2_0",
        **{f"parquet.enable.dictionary#{c}": "false" for c in DELTA},
    }
    for name, value in settings.items():
        writer = writer.option(name, str(value))
    writer.parquet(path)


def read_tokens(
    spark: SparkSession, path: str, where: Column | None = None, columns: tuple[str, ...] | None = None
) -> DataFrame:
    """Rows of the files with `start`, the number of ids of all documents before.

    `where` and `columns` reach the Parquet scan: without `ids` among the columns no
    token page is read, and a range of doc_id reads only the pages that hold it.  The
    files' totals are one row per file and are summed apart from the documents.
    """
    files = spark.read.parquet(path)
    names = list(columns or [c for c in files.columns if c not in ("part", "start_in_part")])
    rows = files.where(where) if where is not None else files
    if "start" not in names and columns is not None:
        return rows.select(*names)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("_total"))
    before = totals.select(
        "part",
        F.expr(
            "coalesce(sum(_total) over (order by part rows between unbounded preceding"
            " and 1 preceding), 0L)"
        ).alias("_before"),
    )
    start = (F.col("_before") + F.col("start_in_part")).alias("start")
    chosen = [start if c == "start" else F.col(c) for c in names]
    if "start" not in names:
        chosen.insert(1, start)
    # One row a file: as many as the folder lists, or else both sides are shuffled.
    few = len(files.inputFiles()) <= MOST_BROADCAST
    return rows.join(F.broadcast(before) if few else before, "part").select(*chosen)


def with_crc32(rows: DataFrame, ids: str = "ids", name: str = "ids_crc32") -> DataFrame:
    """Replace the list by its length and the crc32 of its little-endian 32-bit integers."""
    kept = [f for f in rows.schema.fields if f.name != ids]
    schema = T.StructType([*kept]).add("n_ids", "long").add(name, "long")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(ids)
            values = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            bounds = lists.offsets.to_numpy().tolist()
            sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(bounds, bounds[1:])]
            counts = [b - a for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(f.name) for f in kept], pa.array(counts, pa.int64()), pa.array(sums, pa.int64())],
                names=schema.names,
            )

    return rows.mapInArrow(digest, schema)

"""Token ids in Parquet files laid out for selective reads.

Files hold documents in ascending id order, one list of ids for each. Ids are
dictionary-encoded (16 bits each before compression for a vocabulary of up to
65,536), the ascending id and offset columns delta-encoded. Small pages and a
bounded number of rows in a page give the column and offset indexes, which
Spark's reader uses to skip pages, something to skip; row groups are small
enough for a reader to take one at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import FragmentEncoder, share_tokenizer, with_end
from .common import ship_package, text_pieces

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000

LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.block.size": ROW_GROUP_BYTES,
    "parquet.page.size": PAGE_BYTES,
    "parquet.page.row.count.limit": PAGE_ROWS,
    "parquet.dictionary.page.size": 1 << 20,
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#part_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
}

_FILE = "doc_id bigint, part int, part_start bigint, n_tokens bigint, ids array<int>"


def _rows(name: str, end_id: int):
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("part_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = FragmentEncoder.of(SparkFiles.get(name), digests=False)
        part, before = TaskContext.get().partitionId(), 0
        for piece in text_pieces(batches, "text", 2 << 20):
            ids, ends = encoder.encode(piece.column("text"))[0]
            ids, ends = with_end(np.frombuffer(ids, np.int32), ends // 4, end_id)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(np.full(piece.num_rows, part, np.int32)), pa.array(before + ends[:-1]), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))], schema=schema)
            before += int(ends[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Encode (doc_id bigint, text string, ...) into token files under ``path``.

    ``end_id`` follows the ids of each document. Documents are dealt to files by
    ranges of doc_id and sorted within, null ids first; rows that repeat an id
    lie side by side, ordered by text. A null or empty text has the end id
    alone. Other columns are left out. ``part`` numbers the files in order of
    doc_id and ``part_start`` counts the ids before a document in its file.
    """
    ship_package(docs.sparkSession)
    name = share_tokenizer(docs, tokenizer)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    dealt = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(_rows(name, end_id), _FILE).write.options(**LAYOUT).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens) without reading any id; ``start`` counts the
    ids of all documents before it."""
    return _placed(spark.read.schema(_FILE).parquet(path)).select("doc_id", "start", "n_tokens")


def read_tokens(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids); ``where`` on doc_id skips row groups and pages."""
    files = spark.read.schema(_FILE).parquet(path)
    return _placed(files, where)


def _placed(files: DataFrame, where: Column | None = None) -> DataFrame:
    """Adds ``start``. One row for each file gives the files' offsets; their
    number is that of the writer's partitions, a setting."""
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    chosen = files if where is None else files.filter(where)
    return chosen.join(F.broadcast(offsets), "part").select("doc_id", (F.col("offset") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        lists = batch.column("ids")
        ends = lists.offsets.to_numpy()
        ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        sums = [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(ends, ends[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())], schema=schema)


def checksums(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what read_tokens() returns; the
    checksum is over the ids as little-endian unsigned 32-bit integers."""
    return tokens.mapInArrow(_checksums, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")

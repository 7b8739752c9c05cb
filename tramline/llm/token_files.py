"""Token ids in ORC files: stripes of run-length encoded integers, with row indexes and Bloom filters on document ids.

Rows lie in ascending document order, within files and from file to file, so the minima and maxima that ORC keeps for
each file, stripe and row group prune a read by document id, and Bloom filters prune it further. Readers split files at
stripes. Each row also holds its place in its file, so the place in the whole corpus needs the files' totals only.

Defined results: a null text is empty (the end id alone); a null id sorts first; equal ids lie together in order of
text; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.llm.batches import slices
from tramline.llm.tokens import WordEncoder, kept

FILE_SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, stripe_bytes: int = 16 << 20, rows_per_index: int = 1000, bloom_rate: float = 0.01) -> None:
    """Encode doc_id and text with a byte-level tokenizer file, put end_id after each document, and write ORC to path."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = kept(WordEncoder, tokenizer, True), TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            ids, offsets = encoder.encode(batch.column("text"), end_id)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            columns = [batch.column("doc_id"), pa.array(np.full(batch.num_rows, part), pa.int32()), pa.array(before + offsets[:-1]), pa.array(np.diff(offsets)), lists]
            before += int(offsets[-1])
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "start_in_part", "n_tokens", "ids"])

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    writer = ordered.mapInArrow(encode, FILE_SCHEMA).write
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": bloom_rate, "orc.stripe.size": stripe_bytes, "orc.row.index.stride": rows_per_index, "orc.create.index": "true", "compression": "zstd"}
    writer.options(**options).orc(path)


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """The files' rows; those of some document ids, or from first to last, by pruning on the files' metadata."""
    rows = spark.read.schema(FILE_SCHEMA).orc(path)
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(doc_ids))
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    return rows if last is None else rows.where(F.col("doc_id") <= last)


def token_file_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files alone."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            offsets, data = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False).data
            crcs = [zlib.crc32(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            kept_columns = [batch.column(c) for c in ("doc_id", "part", "start_in_part")]
            yield pa.RecordBatch.from_arrays([*kept_columns, pa.array(np.diff(offsets).astype(np.int64)), pa.array(crcs, pa.int64())], ["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])

    rows = read_token_files(spark, path)
    found = rows.select("doc_id", "part", "start_in_part", "ids").mapInArrow(digest, "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long")
    # One row for each file that was written, at most a shuffle's number of partitions.
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    bases = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    return found.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


"""Token-id files: Parquet with one row per document and its ids as a list column.

Documents are range-partitioned by doc_id, so each file holds a range of ids in ascending order and file order
is doc_id order. Within a file the Parquet v2 writer dictionary-encodes ids or, where a dictionary does not pay,
delta-encodes them; row groups and pages have set sizes and page indexes, so that a reader can take the metadata
columns alone, or the ids of a range of documents alone.

Columns: part (file number), local_start (ids of the documents before it in its file), doc_id, n_tokens, ids.

Defined results: a null or empty text has only the end id. Null doc_ids come first. Rows with one doc_id are
ordered by a hash of their text, and equal rows are kept as they are. An empty table gives an empty file set.
Other columns of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolith.llm._common import new_path, small
from chronolith.llm.tokens import encoder

#: Bytes of a row group and of a page, before compression.
ROW_GROUP, PAGE = 64 << 20, 256 << 10
#: Ids in a batch that goes from Python to the writer.
BATCH_IDS = 1 << 20


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, row_group: int = ROW_GROUP, page: int = PAGE) -> None:
    """Encodes every whole text, appends end_id and writes the files to path."""
    key = docs.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("local_start", T.LongType()), T.StructField("doc_id", key),
        T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
    ])
    end = np.array([end_id], dtype="<u4").tobytes()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, start = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, keep, blobs, size = batch.column("doc_id"), [], [], 0

            def flush(ids=ids, keep=keep, blobs=blobs) -> pa.RecordBatch:
                nonlocal start
                counts = np.array([len(b) // 4 for b in blobs], dtype=np.int64)
                ends = np.cumsum(counts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(np.frombuffer(b"".join(blobs), dtype="<i4")))
                out = pa.RecordBatch.from_arrays([pa.array(np.full(len(keep), part, dtype=np.int32)), pa.array(start + ends - counts), ids.take(pa.array(keep)), pa.array(counts), lists], names=schema.names)
                start += int(ends[-1])
                keep.clear(), blobs.clear()
                return out

            for i, blob in enc.stream(batch.column("text")):
                keep.append(i)
                blobs.append(blob + end)
                size += len(blob) // 4 + 1
                if size >= BATCH_IDS:
                    yield flush()
                    size = 0
            if keep:
                yield flush()

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    options = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true", "parquet.block.size": row_group, "parquet.page.size": page, "compression": "zstd"}
    rows.mapInArrow(encoded, schema).write.options(**options).parquet(path)


def read(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "n_tokens", "ids")) -> DataFrame:
    """Rows of the files with their global start: ids of all documents before. Only the named columns are read."""
    files = spark.read.parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = small(parts.select("part", F.coalesce(F.sum("part_tokens").over(order), F.lit(0)).alias("base")))
    return files.select("part", "local_start", *columns).join(bases, "part").select(*columns[:1], (F.col("base") + F.col("local_start")).alias("start"), *columns[1:])


def ids_crc(df: DataFrame) -> DataFrame:
    """df with its ids replaced by ids_crc32: crc32 of the ids as little-endian unsigned 32-bit integers."""
    kept = [f for f in df.schema.fields if f.name != "ids"]

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat, at = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<i4")).cast("B"), lists.offsets.to_numpy() * 4
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(sums, pa.int64())], names=[*(f.name for f in kept), "ids_crc32"])

    return df.mapInArrow(crc, T.StructType([*kept, T.StructField("ids_crc32", T.LongType())]))


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None) -> DataFrame:
    """Writes the files (to a new folder in the shared one by default), reads them back: doc_id, start, n_tokens, ids_crc32."""
    path = path or new_path(docs.sparkSession, "token-files")
    write(docs, path, tokenizer_path, end_id)
    return ids_crc(read(docs.sparkSession, path))

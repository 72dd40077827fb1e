"""Packing documents into fixed windows by Karmarkar-Karp multiway differencing.

A document's ids, with the separator at their end, are cut into whole windows and a remainder, which is cut once more
if it is longer than half a window (a few pieces to a window balance far better than two). These pieces are gathered
in batches; differencing starts from one partial partition per piece, and merges the two with the
largest imbalance so that the large parts of one meet the small parts of the other, until one partition into
near-equal windows is left. Where its largest window exceeds the capacity, the window count rises and the batch
is partitioned again. A batch holds a bounded number of pieces, so memory is bounded, no row is shuffled, and
a lost task is simply run again.

Padding: a sequence is padded to the window, unless its length is a power of two.

Defined results: a null or empty text is one piece with the separator alone. Equal rows are packed one by one.
Null doc_ids stay null. An empty table gives no pieces. Other columns of the input are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from chronolith.llm.tokens import encoder

#: Pieces that are partitioned at once.
BATCH_PIECES = 1024


def difference(sizes: list[int], windows: int) -> list[tuple[int, list[int]]]:
    """Partitions sizes into so many windows by largest differencing: (sum, places in sizes) of each window that is not empty."""
    # A partial partition has its non-empty parts as (-sum, places), largest first; the other parts are empty.
    heap = [(-s, i, [(-s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) + len(b) > windows:
            # Part i of a meets part windows-1-i of b, so the small end of one meets the large end of the other.
            first = windows - len(b)
            joined = [(s + b[windows - 1 - i][0], p + b[windows - 1 - i][1]) for i, (s, p) in enumerate(a[first:], first)]
            merged = a[:first] + joined + b[: windows - len(a)]
        else:
            merged = a + b
        merged.sort()
        low = merged[-1][0] if len(merged) == windows else 0
        heapq.heappush(heap, (merged[0][0] - low, tick, merged))
        tick += 1
    return [(-s, p) for s, p in heap[0][2]] if heap else []


def partition(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows that hold at most the capacity each: the window count rises until that is so. No size exceeds the capacity."""
    if not sizes:
        return []
    windows = max(-(-sum(sizes) // capacity), sum(2 * s > capacity for s in sizes), 1)
    while True:
        found = difference(sizes, windows)
        over = sum(max(0, s - capacity) for s, _ in found)
        if not over:
            return [p for _, p in found]
        windows += max(1, over // (2 * capacity))


def pack(docs: DataFrame, tokenizer_path: str, separator: int = 0, window: int = 1024, batch_pieces: int = BATCH_PIECES) -> DataFrame:
    """Pieces: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, sequence_length, padded_length."""
    names = ("start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_length", "padded_length")
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(n, T.BinaryType() if n == "ids" else T.LongType()) for n in names)])
    end = np.array([separator], dtype="<u4").tobytes()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sequence = encoder(tokenizer_path), TaskContext.get().partitionId() << 33
        whole: list[tuple] = []  # rows ready to leave
        rest: list[tuple] = []  # (doc_id, start, ids, doc_tokens)

        def row(piece: tuple, offset: int, length: int) -> tuple:
            doc, start, ids, tokens = piece
            padded = length if length & (length - 1) == 0 else window
            return doc, start, len(ids) // 4, ids, tokens, sequence, offset, length, padded

        def settle() -> None:
            nonlocal sequence
            for places in partition([len(p[2]) // 4 for p in rest], window):
                length, offset = sum(len(rest[i][2]) // 4 for i in places), 0
                for i in places:
                    whole.append(row(rest[i], offset, length))
                    offset += len(rest[i][2]) // 4
                sequence += 1
            rest.clear()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*whole, strict=True), types, strict=True)], names=schema.names)
            whole.clear()
            return out

        types: list[pa.DataType] = []
        for batch in batches:
            types = types or [batch.column("doc_id").type, *(pa.binary() if n == "ids" else pa.int64() for n in names)]
            keys = batch.column("doc_id").to_pylist()
            for i, blob in enc.stream(batch.column("text")):
                blob += end
                tokens, full = len(blob) // 4, len(blob) // (4 * window)
                for k in range(full):
                    whole.append(row((keys[i], k * window, blob[4 * k * window : 4 * (k + 1) * window], tokens), 0, window))
                    sequence += 1
                    if len(whole) >= batch_pieces:
                        yield flush()
                for at in range(full * window, tokens, window // 2):
                    rest.append((keys[i], at, blob[4 * at : 4 * (at + window // 2)], tokens))
                if len(rest) >= batch_pieces:
                    settle()
                if len(whole) >= batch_pieces:
                    yield flush()
        settle()
        if whole:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(packed, schema)

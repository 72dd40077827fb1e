"""Exact top-k search by inner product: tiled matrix products and a tree of merges.

Rows and queries are dealt by a hash of their contents over a grid of cells, each with a bounded number of queries
and of rows, so that no task holds more than one cell; a cell multiplies its matrices block by block, keeps the k best
of each query, and the lists of a query are merged fan-in by fan-in. Neither side is broadcast or collected.

Scores order rows descending, ties by ascending id. The row with the query's own id is not a candidate.

Defined results: a vector that is null or holds a null or non-finite component takes no part. Vectors of different
lengths are not compared. Rows with one id are rows of their own as candidates; as queries, equal rows are one query
and different ones are queries of their own. A null id takes no part. A score beyond 64 bits counts as the nearest number
of 64 bits, so vectors of very large components are ranked by id where they have that score. An empty table gives no rows.
Other columns of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a cell's queries and of its rows, as doubles; query rows of one matrix product; lists of a query that are merged at once.
CELL_BYTES, BLOCK, FAN_IN = 16 << 20, 64, 32
_MOST = (1 << 63) - 1


def best(queries: np.ndarray, own: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in queries, place in rows, score) of each query's k best rows. ids ascend; matrices hold whole numbers as doubles."""
    n, places, found, scores = len(ids), [], [], []
    largest = float(max(np.abs(queries).max(initial=0), 1)) * float(max(np.abs(rows).max(initial=0), 1)) * max(1, rows.shape[1])
    exact = np.float64 if largest < 2**53 else object  # beyond doubles' exact range: Python's integers
    whole = lambda m: m if exact is np.float64 else np.array([[int(x) for x in line] for line in m], dtype=object).reshape(m.shape)
    a, b = whole(queries), whole(rows).T
    k = min(k, n)
    for at in range(0, len(queries), BLOCK):
        product = a[at : at + BLOCK] @ b
        if exact is object:
            product = np.array([[min(max(x, -_MOST), _MOST) for x in line] for line in product], dtype=np.int64).reshape(product.shape)
        lows, highs = np.searchsorted(ids, own[at : at + BLOCK]), np.searchsorted(ids, own[at : at + BLOCK], "right")
        own_rows = [(i, lo, hi) for i, (lo, hi) in enumerate(zip(lows, highs, strict=True)) if hi > lo]
        if exact is np.float64 and largest * n < 2**62:
            # Score and place in one integer: all differ, and the smaller place is the larger number.
            mixed = product.astype(np.int64) * n + np.arange(n - 1, -1, -1)
            for i, lo, hi in own_rows:
                mixed[i, lo:hi] = np.iinfo(np.int64).min
            top = np.argpartition(mixed, n - k, axis=1)[:, n - k :]
        else:
            top = np.empty((len(product), k), dtype=np.int64)
            for i, line in enumerate(product.astype(np.int64)):
                top[i] = np.lexsort((np.arange(n), -line, ids == own[at + i]))[:k]
        query = np.repeat(np.arange(at, at + len(product)), k)
        row = top.ravel()
        keep = ids[row] != own[query]
        places.append(query[keep])
        found.append(row[keep])
        scores.append(np.take_along_axis(product, top, 1).ravel()[keep].astype(np.int64))
    empty = np.empty(0, dtype=np.int64)
    return tuple(np.concatenate(x) if x else empty for x in (places, found, scores))


def exact_topk(vectors: DataFrame, is_query: Column, k: int, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", cell_queries: int | None = None, cell_rows: int | None = None) -> DataFrame:
    """query_id, rank (from 1), the row's id and score: components are floor(scale * x) of the vector's doubles."""
    finite = ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite).select(
        F.col(id_col).alias("id"), is_query.alias("is_query"),
        F.transform(vector_col, lambda x: F.lit(scale) * x.cast("double")).alias("v"),
    ).withColumns({"dim": F.size("v"), "h": F.xxhash64("id", "v")})
    counts = rows.agg(F.count("*").alias("n"), F.count_if("is_query").alias("q"), F.max("dim").alias("dim")).first()
    fits = max(1, CELL_BYTES // (8 * max(counts["dim"] or 1, 1)))
    cell_queries, cell_rows = cell_queries or fits, cell_rows or fits
    row_parts, query_parts = max(1, -(-counts["n"] // cell_rows)), max(1, -(-counts["q"] // cell_queries))
    part = lambda n: F.pmod(F.col("h"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.where("is_query").dropDuplicates(["id", "h", "v"]).select("dim", "id", "h", "v", part(query_parts).alias("qp"), each(row_parts).alias("rp"))
    # Columns of their own names: both sides come from one frame.
    right = rows.select(F.col("dim").alias("row_dim"), F.col("id").alias("row_id"), F.col("v").alias("row_v"), part(row_parts).alias("row_rp"), each(query_parts).alias("row_qp"))

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["query_id", "h", "rp", "vec_id", "score"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        if not len(a) or not len(b):
            return pa.table([pa.array([], t) for t in kinds], names=names)
        matrix = lambda t, c: np.floor(t.column(c).combine_chunks().flatten().to_numpy()).reshape(len(t), -1)
        own, ids = a.column("id").to_numpy(), b.column("row_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        query, row, score = best(matrix(a, "v"), own, matrix(b, "row_v")[order], ids, k)
        rp = np.full(len(query), a.column("rp")[0].as_py(), dtype=np.int32)
        return pa.table([pa.array(x, t) for x, t in zip((own[query], a.column("h").to_numpy()[query], rp, ids[row], score), kinds, strict=True)], names=names)

    top = left.groupBy("dim", "qp", "rp").cogroup(right.groupBy("row_dim", "row_qp", "row_rp")).applyInArrow(cell, "query_id long, h long, rp int, vec_id long, score long")
    order = (F.desc("score"), F.asc("vec_id"))
    while row_parts > FAN_IN:
        top = top.withColumn("rp", (F.col("rp") / FAN_IN).cast("int"))
        top = top.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "h", "rp").orderBy(*order))).where(F.col("rank") <= k).drop("rank")
        row_parts = -(-row_parts // FAN_IN)
    rank = F.row_number().over(Window.partitionBy("query_id", "h").orderBy(*order))
    return top.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)

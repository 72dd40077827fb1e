"""Algebra of id streams. The left side keeps its order and repeats in intersect and except; union drops repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def intersect(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    return left.join(right.select(key), key, "left_semi")


def except_(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    return left.join(right.select(key), key, "left_anti")


def union(left: DataFrame, right: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """Left, then what only right has, each id once. With an order column, side and that column tell the order of the first of each."""
    if order is None:
        return left.select(key).union(right.select(key)).distinct()
    both = left.select(key, F.lit(0).alias("side"), order).union(right.select(key, F.lit(1).alias("side"), order))
    return both.groupBy(key).agg(F.min(F.struct("side", order)).alias("at")).select(key, "at.side", f"at.{order}")


def in_order(ids: DataFrame, order: str) -> DataFrame:
    """The union's rows with pos, their place in the stream (for results that fit one task)."""
    return ids.withColumn("pos", F.row_number().over(Window.orderBy("side", order)).cast("long"))

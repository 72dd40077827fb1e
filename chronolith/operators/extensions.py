"""What Spark adds, which no record store of this kind has: joins along pivots, aggregates, event-time windows, a version
as of an instant for each of many requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def children(parents: DataFrame, records: DataFrame, on: Column | str | list[str]) -> DataFrame:
    """Records of the collections that parents name."""
    return parents.join(records, on)


def windowed(stream: DataFrame, time: str, width: str, *keys: str, late: str | None = None, **aggregates: Column) -> DataFrame:
    """Tumbling event-time windows; with late, rows later than that are dropped in a stream."""
    frame = stream.withWatermark(time, late) if late else stream
    out = frame.groupBy(F.window(time, width).alias("w"), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(F.col("w.start").alias("window_start"), *keys, *aggregates)


def as_of_join(requests: DataFrame, versions: DataFrame, keys: list[str], at: str = "at", instant: str = "instant") -> DataFrame:
    """Each request (keys, at) with the last version at or before it, found in one sorted pass: no range join.

    Both sides are sorted together by time within a key; a request takes the last version above it.
    """
    body = [c for c in versions.columns if c not in keys]
    left = requests.select(*keys, F.col(at).alias("__t"), F.lit(1).alias("__side"), F.struct(*[c for c in requests.columns if c not in keys]).alias("__request"))
    right = versions.select(*keys, F.col(instant).alias("__t"), F.lit(0).alias("__side"), F.struct(*body).alias("__version"))
    both = left.unionByName(right, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("__version", F.last("__version", ignorenulls=True).over(order)).where("__side = 1")
    return found.select(*keys, "__request.*", F.col("__version").alias("version"))


def readable(frame: DataFrame, tenant: int, groups: tuple[int, ...] = ()) -> DataFrame:
    """The versions that a tenant, in some groups, may read by their permission: none (the record's own tenant alone), "public",
    "tenants:" and tenants, or "group:" and a group."""
    permission = F.col("permission")
    named = F.array_contains(F.split(F.substring_index(permission, ":", -1), ","), str(tenant))
    grouped = permission.isin([f"group:{g}" for g in groups]) if groups else F.lit(False)
    granted = (permission == "public") | (permission.startswith("tenants:") & named) | grouped
    return frame.where((F.col("tenant") == tenant) | F.coalesce(granted, F.lit(False)))

"""Watches: saves and removals of committed batches after a cursor, each told once.

What is streamed is the log's commits, so an event is told only once it is durable, and in the order of commits: a
collection's instants only rise, so its greatest instant told, its cursor, is all the state there is. The data of a
micro-batch is read as DataFrames, what is at or below the cursors is dropped, and events and cursors are written by batch
number, so a batch that is run again after a failure writes the same. A compaction holds what was told before as well;
the cursors drop that.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chronolith.sources.store import Commit, LogStore

#: An idle poll waits this many times longer than the one before, up to so many times the first interval.
IDLE_GROWTH, MOST_IDLE = 2, 16


def events(versions: DataFrame, removals: DataFrame) -> DataFrame:
    """Saves (with their body) and removals as events."""
    saved = versions.withColumn("event", F.lit("saved"))
    return saved.unionByName(removals.withColumn("event", F.lit("removed")), allowMissingColumns=True)


def after(found: DataFrame, cursors: DataFrame | None, since: int) -> DataFrame:
    """Events above their collection's cursor, or above since where it has none."""
    if cursors is None:
        return found.where(F.col("instant") > since)
    return found.join(cursors, ["tenant", "pivot"], "left").where(F.col("instant") > F.coalesce("cursor", F.lit(since))).drop("cursor")


class Watch:
    """A watch that keeps its events under path/events and its cursors under path/cursors.

    tenant and pivot narrow it to a tenant or one collection. mirror(versions, removals), if given, is called with what a
    batch tells before its events are written, so that whoever reads an event finds its record mirrored.
    """

    def __init__(self, store: LogStore, path: str, tenant: int | None = None, pivot: int | None = None, since: int = -1, mirror: Callable[[DataFrame, DataFrame], object] | None = None):
        self.store, self.path, self.since, self.mirror = store, path.rstrip("/"), since, mirror
        self.only = F.lit(True)
        for column, value in (("tenant", tenant), ("pivot", pivot)):
            if value is not None:
                self.only = self.only & (F.col(column) == value)

    def _batches(self, kind: str) -> list[int]:
        fs, at = self.store._hadoop(f"{self.path}/{kind}")
        return sorted(int(s.getPath().getName()[6:]) for s in fs.listStatus(at)) if fs.exists(at) else []

    def _cursors(self, before: int) -> DataFrame | None:
        held = [b for b in self._batches("cursors") if b < before]
        return self.store.spark.read.schema("tenant long, pivot long, cursor long").parquet(f"{self.path}/cursors/batch={held[-1]}") if held else None

    def _tell(self, manifests: DataFrame, batch: int) -> None:
        # As many rows as a micro-batch has commits, which the source bounds.
        commits = sorted((Commit(**r.asDict()) for r in manifests.fillna({"compacts": False}).collect()), key=lambda c: c.number)
        cursors = self._cursors(batch)
        parts = [after(self.store.read(kind, commits).where(self.only), cursors, self.since) for kind in ("versions", "removals")]
        if self.mirror:
            self.mirror(*parts)
        events(*parts).sortWithinPartitions("tenant", "pivot", "instant").write.mode("overwrite").parquet(f"{self.path}/events/batch={batch}")
        told = self.store.spark.read.parquet(f"{self.path}/events/batch={batch}").groupBy("tenant", "pivot").agg(F.max("instant").alias("cursor"))
        if cursors is not None:
            told = cursors.unionByName(told).groupBy("tenant", "pivot").agg(F.max("cursor").alias("cursor"))
        told.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/cursors/batch={batch}")

    def start(self, interval: str | None = None) -> StreamingQuery:
        """Starts the watch: with an interval it goes on ("0 seconds": as commits come), without one it ends once it has told what is there."""
        writer = self.store.stream().writeStream.foreachBatch(self._tell).option("checkpointLocation", f"{self.path}/checkpoint")
        return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()

    def catch_up(self) -> DataFrame:
        """All events told so far, after a run over what is there. Later calls, and restarts, tell only what is new."""
        self.start().awaitTermination()
        return self.told()

    def told(self) -> DataFrame:
        schema = events(self.store.read("versions", []), self.store.read("removals", [])).schema
        held = [f"{self.path}/events/batch={b}" for b in self._batches("events")]
        return self.store.spark.read.schema(schema).parquet(*held) if held else self.store.spark.createDataFrame([], schema)


def watch_collection(store: LogStore, path: str, session, pivot: int = 0, since: int = -1, mirror=None) -> Watch:
    """Events of one collection, of the session's tenant alone."""
    return Watch(store, path, session.tenant, pivot, since, mirror)


def watch_unique(store: LogStore, path: str, session, since: int = -1, mirror=None) -> Watch:
    """Versions of the session's tenant's record."""
    return Watch(store, path, session.tenant, None, since, mirror)


def poll(changes: Callable[[int | None], tuple[DataFrame, int]], cursor: int | None = None, interval: float = 1.0, until: Callable[[], bool] = lambda: False, sleep: Callable[[float], object] = time.sleep) -> Iterator[DataFrame]:
    """Batches of changes without a stream: changes(cursor) is asked at the interval, and ever less often while it has nothing.

    The first call registers: its cursor comes back before any event does.
    """
    if cursor is None:
        _, cursor = changes(None)
    wait = interval
    while not until():
        found, now = changes(cursor)
        if now > cursor:
            cursor, wait = now, interval
            yield found
        else:
            sleep(wait)
            wait = min(wait * IDLE_GROWTH, interval * MOST_IDLE)

"""Views over the version log V and the removal log R.

V has a row per authored version: tenant, pivot, rec (any orderable type), instant, enters (this write put the record
into the living set: a first insert, or one that revives) and the body's columns. R has a row per removal that took
effect: tenant, pivot, rec, instant. Nothing in either is ever changed; which version is live, what came before it and
whether the record lives are derived.

A record lives if it was last entered after it was last removed. That takes two maxima, so one aggregation with partial
results gives the live state of every record: one shuffle of V and R by record, no sort and no replay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ANCHOR = ("tenant", "pivot", "rec")


def _body(versions: DataFrame) -> list[str]:
    return [c for c in versions.columns if c not in (*ANCHOR, "instant", "enters")]


def latest(versions: DataFrame, removals: DataFrame | None = None) -> DataFrame:
    """Each record's live version, with removed: whether it was removed since it last entered. Records that only a plain
    save wrote never entered: they are found by address, and are not in the living set (in_living false)."""
    body = _body(versions)
    packed = versions.select(*ANCHOR, "instant", F.struct("instant", *body).alias("version"), F.when(F.col("enters"), F.col("instant")).alias("entered"), F.lit(None).cast("long").alias("gone"))
    if removals is not None:
        empty = F.lit(None).cast(packed.schema["version"].dataType)
        packed = packed.unionByName(removals.select(*ANCHOR, F.lit(None).cast("long").alias("instant"), empty.alias("version"), F.lit(None).cast("long").alias("entered"), F.col("instant").alias("gone")))
    state = packed.groupBy(*ANCHOR).agg(F.max_by("version", "instant").alias("version"), F.max("entered").alias("entered"), F.max("gone").alias("gone"))
    alive = F.coalesce(F.col("entered") > F.coalesce("gone", F.lit(-1)), F.lit(False))
    return state.where("version is not null").select(*ANCHOR, "version.*", (F.col("gone").isNotNull() & ~alive).alias("removed"), alive.alias("in_living"))


def living(versions: DataFrame, removals: DataFrame | None = None) -> DataFrame:
    """Live versions of the records that live."""
    return latest(versions, removals).where("in_living").drop("removed", "in_living")


def unique_latest(versions: DataFrame) -> DataFrame:
    """A unique type's record of each tenant: its last version."""
    body = [c for c in versions.columns if c not in ("tenant", "instant")]
    return versions.groupBy("tenant").agg(F.max_by(F.struct("instant", *body), "instant").alias("v")).select("tenant", "v.*")


def recency(live: DataFrame) -> DataFrame:
    """The living, most recently written first (pos from 1 within a tenant's collection); ties by address, descending."""
    order = Window.partitionBy("tenant", "pivot").orderBy(F.desc("instant"), F.desc("rec"))
    return live.withColumn("pos", F.row_number().over(order).cast("long"))


def history(versions: DataFrame, keys: tuple[str, ...] = ANCHOR) -> DataFrame:
    """Every version with the instants before and after it and its place, ver (1: live)."""
    order = Window.partitionBy(*keys).orderBy(F.desc("instant"))
    return versions.withColumns({"previous": F.lead("instant").over(order), "next": F.lag("instant").over(order), "ver": F.row_number().over(order).cast("long")})


def created_at_range(low: int, high: int) -> Column:
    """Instants from low on and below high, as a predicate that Parquet's statistics prune by; an empty range holds nothing."""
    return (F.col("instant") >= low) & (F.col("instant") < high) if low < high else F.lit(False)


def of_keys(frame: DataFrame, changed: DataFrame) -> DataFrame:
    return frame.join(changed, list(ANCHOR), "left_semi")


def changes(versions: DataFrame, removals: DataFrame, cursor: int) -> DataFrame:
    """What changed in collections since a cursor: the live version of each record saved since (saves between collapse) and
    each removal since, by instant; new_cursor is the greatest instant of the tenant's collection that is told.

    Only records with a version after the cursor are looked at, so the state of the rest is never computed.
    """
    changed = versions.where(F.col("instant") > cursor).select(*ANCHOR).distinct()
    saved = living(of_keys(versions, changed), of_keys(removals, changed)).where(F.col("instant") > cursor)
    removed = removals.where(F.col("instant") > cursor).select(*ANCHOR, "instant", F.lit("removed").alias("event"))
    events = saved.withColumn("event", F.lit("saved")).unionByName(removed, allowMissingColumns=True)
    told = F.max("instant").over(Window.partitionBy("tenant", "pivot"))
    return events.withColumn("new_cursor", F.greatest(F.lit(cursor), told))


def tail(versions: DataFrame, removals: DataFrame) -> DataFrame:
    """Registration: the tail of each tenant's collection, to be used as a cursor, and no events."""
    ends = living(versions, removals).select("tenant", "pivot", "instant").unionByName(removals.select("tenant", "pivot", "instant"))
    return ends.groupBy("tenant", "pivot").agg(F.max("instant").alias("cursor"))


def unique_changes(versions: DataFrame, cursors: DataFrame) -> DataFrame:
    """What changed in unique records since cursors (tenant, cursor): every version missed, in authoring order, if the
    cursor is one of the record's versions; the live version alone if it is not; nothing if it is the live one or later."""
    mine = Window.partitionBy("tenant", "cursor")
    held = versions.join(cursors.where("cursor is not null"), "tenant")
    marked = held.withColumns({"live": F.max("instant").over(mine), "known": F.max((F.col("instant") == F.col("cursor")).cast("int")).over(mine) == 1})
    missed = (F.col("cursor") < F.col("live")) & (F.col("instant") > F.col("cursor")) & (F.col("known") | (F.col("instant") == F.col("live")))
    return marked.where(missed).drop("known").withColumnRenamed("live", "new_cursor")


def as_of(versions: DataFrame, removals: DataFrame, instant: int) -> DataFrame:
    """The living set at an instant (an extension)."""
    return living(versions.where(F.col("instant") <= instant), removals.where(F.col("instant") <= instant))


def from_operations(log: DataFrame, is_remove: Column) -> tuple[DataFrame, DataFrame]:
    """(V, R) of a keyed type from a log of saves and removals (tenant, pivot, rec, instant, body): a removal takes effect
    only on a record that lives, and a save of one that does not enters it."""
    order = Window.partitionBy(*ANCHOR).orderBy("instant")
    marked = log.withColumn("__remove", is_remove).withColumn("__before", F.lag("__remove").over(order))
    versions = marked.where("not __remove").withColumn("enters", F.coalesce("__before", F.lit(True))).drop("__remove", "__before")
    removals = marked.where("__remove and not __before").select(*ANCHOR, "instant")
    return versions, removals

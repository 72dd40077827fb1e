"""Handles with which an application reads and writes: Collection (many records) and UniqueRecord (one per tenant).

Writes are planned on the state of one commit and published as the next, so they are atomic and a concurrent writer gets
Conflict. Instants are strictly above every instant of the collection (its floor), whatever the clock does. Batches go
through DataFrames: insert_all and save_all take as many rows as there are; their rows are staged with a place in their
file, so instants are the floor, the rows of the files before and that place, gapless and the same when a task runs again.

Pivot 0 is a tenant's own collection of a type, which is always there. Others are made by Collection.create, and what was
not made is refused with PivotMissing.
"""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from chronolith.errors import FuzzyOutOfRange, InvalidRecord, KeyMismatch, ListOutOfRange, PivotMissing, RecordMissing, SecondaryIndexOutOfRange
from chronolith.model import U48, RecordType, Shape
from chronolith.operators import fuzzy, reads
from chronolith.operators.bounds import All, Exact
from chronolith.plans import views
from chronolith.sources import LogStore


@dataclass(frozen=True)
class Session:
    """Who reads and writes: everything a handle does is of its tenant."""

    tenant: int
    user: int | None = None
    anonymous: bool = False

    def __post_init__(self) -> None:
        if not 0 <= self.tenant < U48:
            raise InvalidRecord("a tenant is an unsigned 48-bit number")

    def as_tenant(self, tenant: int) -> Session:
        """The same user in another tenant; for server functions."""
        return Session(tenant, self.user, self.anonymous)


def mint(floor: int) -> int:
    """An instant above the floor: unix nanoseconds, or the floor's successor if the clock is behind."""
    return max(time.time_ns(), floor + 1)


class _Handle:
    def __init__(self, kind: RecordType, store: LogStore, session: Session, pivot: int = 0):
        self.kind, self.store, self.session, self.pivot = kind, store, session, pivot

    def _mine(self, frame: DataFrame) -> DataFrame:
        return frame.where((F.col("tenant") == self.session.tenant) & (F.col("pivot") == self.pivot))

    def versions(self) -> DataFrame:
        return self._mine(self.store.versions())

    def removals(self) -> DataFrame:
        return self._mine(self.store.removals())

    def triples(self, rows: DataFrame | None = None) -> DataFrame:
        """id, metadata and body of versions (the latest ones by default), each a struct: what goes over a wire."""
        rows = self.latest() if rows is None else rows
        meta = ["instant", "author", "device_created", "permission"]
        return rows.select(F.struct("tenant", "pivot", "rec").alias("id"), F.struct(*meta).alias("metadata"), F.struct(*self.kind.body.fieldNames()).alias("body"))

    def _row(self, rec: str, instant: int, enters: bool, values: dict, removed: bool = False, permission: str | None = None, author: int | None = None) -> tuple:
        unknown = set(values) - set(self.kind.body.fieldNames())
        if unknown:
            raise InvalidRecord(f"{self.kind.name} has no {sorted(unknown)}")
        author = self.session.user if author is None else author
        return (self.session.tenant, self.pivot, rec, instant, enters, removed, author, instant, permission, *(values.get(f) for f in self.kind.body.fieldNames()))

    def _frame(self, rows: list[tuple]) -> DataFrame:
        return self.store.spark.createDataFrame(rows, self.store.schema)

    def _base(self) -> int:
        seen = self.store.commits()
        return seen[-1].number if seen else 0


class Collection(_Handle):
    """Many records of a type under one pivot."""

    def __init__(self, kind: RecordType, store: LogStore, session: Session, pivot: int = 0):
        if kind.shape is not Shape.NON_UNIQUE:
            raise InvalidRecord(f"{kind.name} has one record per tenant")
        super().__init__(kind, store, session, pivot)
        self._there = False

    @classmethod
    def create(cls, kind: RecordType, store: LogStore, session: Session) -> Collection:
        """A new, empty collection of the session's tenant; its pivot is to be kept in the record that owns it."""
        seen = store.commits()
        made = store.pivots().agg(F.max("pivot")).first()[0] or 0
        return cls.adopt_pivot(kind, store, session, mint(made), base=seen[-1].number if seen else 0)

    @classmethod
    def adopt_pivot(cls, kind: RecordType, store: LogStore, session: Session, pivot: int, base: int | None = None) -> Collection:
        """The collection under a pivot that another node made; it is made here unless it is there."""
        found = cls(kind, store, session, pivot)
        if not found._exists():
            store.apply(pivots=store.spark.createDataFrame([(session.tenant, pivot)], "tenant long, pivot long"), base=base)
            found._there = True
        return found

    def _exists(self) -> bool:
        if self.pivot and not self._there:
            self._there = not self._mine(self.store.pivots()).isEmpty()
        return self.pivot == 0 or self._there

    def _log(self) -> tuple[DataFrame, DataFrame]:
        if not self._exists():
            raise PivotMissing(f"{self.kind.name}: no collection {self.pivot} of tenant {self.session.tenant}")
        return self.versions().drop("removed"), self.removals()

    # Reads

    def latest(self) -> DataFrame:
        return views.latest(*self._log())

    def living(self) -> DataFrame:
        return views.living(*self._log())

    def all(self) -> DataFrame:
        """The living, most recently written first: sorted by ranges, in as many tasks as there are."""
        return self.living().orderBy(F.desc("instant"), F.desc("rec"))

    def get(self, rec: str) -> Row | None:
        return self.latest().where(F.col("rec") == rec).first()

    def anchor(self, rec: str) -> str:
        found = self.get(rec)
        return "vacant" if found is None else "dead" if found["removed"] else "living"

    def by(self, *fields: str, **values) -> DataFrame:
        """Equality lookup by a declared index: by("city", city="Bern")."""
        fields = fields or tuple(values)
        return self.search_by(self._index(fields), Exact(tuple(values[f] for f in fields)))

    def _index(self, fields: tuple[str, ...]) -> int:
        if fields not in self.kind.pivots:
            raise SecondaryIndexOutOfRange(f"{self.kind.name} has no index on {fields}")
        return self.kind.pivots.index(fields)

    def search_by(self, index: int, bound) -> DataFrame:
        if not 0 <= index < len(self.kind.pivots):
            raise SecondaryIndexOutOfRange(f"{self.kind.name} has {len(self.kind.pivots)} indexes")
        fields = self.kind.pivots[index]
        return self.living().where((bound or All()).predicate(fields)).orderBy(*fields, "rec")

    def contains(self, *recs: str) -> DataFrame:
        """rec and living of each address asked for: membership, without the records."""
        asked = self.store.spark.createDataFrame([(r,) for r in recs], "rec string")
        versions, removals = self._log()
        only = F.col("rec").isin(*recs)
        alive = views.living(versions.where(only).select("tenant", "pivot", "rec", "instant", "enters"), removals.where(only)).select("rec", F.lit(True).alias("__in"))
        return asked.join(alive, "rec", "left").select("rec", F.col("__in").isNotNull().alias("living"))

    def greatest(self, index: int) -> Row | None:
        """The record with the greatest key of an index: one pass with partial maxima, no sort."""
        if not 0 <= index < len(self.kind.pivots):
            raise SecondaryIndexOutOfRange(f"{self.kind.name} has {len(self.kind.pivots)} indexes")
        live = self.living()
        found = live.agg(F.max_by(F.struct(*live.columns), F.struct(*self.kind.pivots[index], "rec")).alias("r")).first()
        return found["r"]

    def created_between(self, low: int, high: int) -> DataFrame:
        """The living written from instant low on and below high: the range prunes row groups before liveness is found."""
        versions, removals = self._log()
        written = views.of_keys(versions, versions.where(views.created_at_range(low, high)).select(*views.ANCHOR).distinct())
        return views.living(written, removals).where(views.created_at_range(low, high))

    def _list(self, index: int) -> tuple[str, ...]:
        if not 0 <= index < len(self.kind.lists):
            raise ListOutOfRange(f"{self.kind.name} has {len(self.kind.lists)} lists")
        return self.kind.lists[index]

    def listed(self, index: int = 0, offset: int = 0, limit: int | None = None) -> DataFrame:
        """A list from an offset on. Its first rows come from a bounded heap in each task; deeper ones, and all to the end, from
        the stored list of the last commit, of which only the row groups that hold them are read."""
        keys = self._list(index)
        if limit is not None and offset + limit <= reads.SHALLOW:
            return reads.listed(self.living(), keys, offset=offset, limit=limit)
        if not offset and limit is None:
            return self.living().orderBy(*keys, "rec")
        return self.stored_list(index).page(offset, limit).orderBy("pos").drop("pos")

    def stored_list(self, index: int = 0) -> reads.StoredList:
        """The list with places as of the last commit, written when it is first asked for and kept until vacuum_lists()."""
        keys = self._list(index)
        path = f"{self.store.path}/lists/{self.session.tenant}-{self.pivot}-{index}-{self._base():012d}"
        fs, at = self.store._hadoop(f"{path}/_SUCCESS")
        if not fs.exists(at):
            return reads.StoredList.write(self.living(), keys, path)
        return reads.StoredList(self.store.spark, path)

    def vacuum_lists(self) -> None:
        """Deletes this collection's stored lists of earlier commits."""
        fs, at = self.store._hadoop(f"{self.store.path}/lists")
        for status in fs.listStatus(at) if fs.exists(at) else ():
            name = status.getPath().getName()
            if name.startswith(f"{self.session.tenant}-{self.pivot}-") and not name.endswith(f"-{self._base():012d}"):
                fs.delete(status.getPath(), True)

    def listed_at_page(self, page: int, page_size: int, index: int = 0) -> DataFrame:
        return self.listed(index, page * page_size)

    def list_len(self, index: int = 0) -> int:
        self._list(index)
        return self.living().count()

    def store_list(self, path: str, index: int = 0) -> reads.StoredList:
        return reads.StoredList.write(self.living(), self._list(index), path)

    def fuzzy_search(self, query: str, mode: fuzzy.Mode, limit: int | None = None, index: int = 0, exhaustive: bool = False) -> DataFrame:
        if not 0 <= index < len(self.kind.fuzzy):
            raise FuzzyOutOfRange(f"{self.kind.name} has {len(self.kind.fuzzy)} fuzzy indexes")
        x = self.kind.fuzzy[index]
        if exhaustive or x not in self.store.fuzzy:
            return fuzzy.search(self.living(), x.field, query, mode, limit, x.n, x.fold, exhaustive=exhaustive)
        # Postings of every version are kept with the log; the few records they name are looked at as they are now.
        named = fuzzy.candidates(self._mine(self.store.postings()).where(F.col("field") == x.field), query, mode, x.n, x.fold, ("tenant", "pivot", "rec", "instant"))
        keys = named.select(*views.ANCHOR).distinct()
        versions, removals = self._log()
        live = views.living(views.of_keys(versions, keys), views.of_keys(removals, keys))
        return fuzzy.search(live, x.field, query, mode, limit, x.n, x.fold)

    def history(self, rec: str) -> DataFrame:
        """Live version first. A record without versions is an error."""
        mine = self._log()[0].where(F.col("rec") == rec)
        if mine.isEmpty():
            raise RecordMissing(rec)
        return views.history(mine).orderBy("ver")

    def changes(self, cursor: int | None = None) -> tuple[DataFrame, int]:
        """(events, next cursor). Without a cursor: no events, and the cursor to begin with."""
        versions, removals = self._log()
        if cursor is None:
            row = views.tail(versions, removals).first()
            return views.changes(versions, removals, (1 << 63) - 1).limit(0), row["cursor"] if row else 0
        events = views.changes(versions, removals, cursor).drop("new_cursor").orderBy("instant")
        return events, max(cursor, events.agg(F.max("instant")).first()[0] or 0)

    # Writes

    def _state(self, rec: str | None = None) -> tuple[int, int, Row | None]:
        """The last commit, the collection's floor and the record as it is now (or None), of one pass over the log."""
        base = self._base()
        versions, removals = self._log()
        here = F.col("rec") == rec if rec is not None else F.lit(False)
        body = [c for c in versions.columns if c not in (*views.ANCHOR, "instant", "enters")]
        ends = versions.select("instant", F.when(here, F.struct("instant", *body)).alias("version"), F.when(here & F.col("enters"), F.col("instant")).alias("entered"), F.lit(None).cast("long").alias("gone"))
        gone = removals.select("instant", F.lit(None).cast(ends.schema["version"].dataType).alias("version"), F.lit(None).cast("long").alias("entered"), F.when(here, F.col("instant")).alias("gone"))
        r = ends.unionByName(gone).agg(F.max("instant").alias("floor"), F.max_by("version", F.col("version.instant")).alias("version"), F.max("entered").alias("entered"), F.max("gone").alias("gone")).first()
        if r["version"] is None:
            return base, r["floor"] or 0, None
        lives = r["entered"] is not None and r["entered"] > (r["gone"] or -1)
        now = Row(**r["version"].asDict(), in_living=lives, removed=r["gone"] is not None and not lives)
        return base, r["floor"], now

    def _addresses(self) -> Column:
        return F.to_json(F.array(*[F.col(f).cast("string") for f in self.kind.key]))

    def insert(self, **values) -> str:
        """A new record; for a keyed type the record of its key, which a save chains to and a removed one is revived by."""
        keyed = self._keyed(values) if self.kind.key else None
        base, floor, now = self._state(keyed)
        instant = mint(floor)
        rec = keyed or f"{instant:020d}"
        enters = now is None or not now["in_living"]
        self.store.apply(self._frame([self._row(rec, instant, enters, values, permission=now["permission"] if now else None)]), base=base)
        return rec

    def _keyed(self, values: dict) -> str:
        """The address of a keyed value, the same as insert_all's."""
        return json.dumps([None if values[f] is None else str(values[f]).lower() if isinstance(values[f], bool) else str(values[f]) for f in self.kind.key], ensure_ascii=False, separators=(",", ":"))

    @contextlib.contextmanager
    def _staged(self, rows: DataFrame, columns: list[str], floor: int):
        """rows, written to a folder and read back with instants from the floor's successor on; the folder goes in the end."""
        path = f"{self.store.path}/staging/{uuid.uuid4().hex}"
        number = F.monotonically_increasing_id()
        try:
            rows.select(*columns, F.shiftright(number, 33).cast("int").alias("__part"), number.bitwiseAND(F.lit((1 << 33) - 1)).alias("__place")).write.parquet(path)
            staged = self.store.spark.read.parquet(path)
            # One row per file, however many records there are.
            counts = staged.groupBy("__part").agg(F.count("*").alias("n")).orderBy("__part").collect()
            offsets, at = [], 0
            for r in counts:
                offsets.append((r["__part"], at))
                at += r["n"]
            bases = F.broadcast(self.store.spark.createDataFrame(offsets, "__part int, __base long"))
            yield staged.join(bases, "__part").withColumn("instant", F.lit(mint(floor)) + F.col("__base") + F.col("__place")).drop("__part", "__place", "__base")
        finally:
            fs, at = self.store._hadoop(path)
            fs.delete(at, True)

    def _commit(self, placed: DataFrame, enters: Column, removed: Column, base: int, permission: Column) -> int:
        meta = [F.lit(self.session.tenant).cast("long").alias("tenant"), F.lit(self.pivot).cast("long").alias("pivot"), "rec", "instant", enters.alias("enters"), removed.alias("removed"), F.lit(self.session.user).cast("long").alias("author"), F.col("instant").alias("device_created"), permission.alias("permission")]
        return self.store.apply(placed.select(*meta, *self.kind.body.fieldNames()), base=base)

    def insert_all(self, rows: DataFrame) -> int:
        """Inserts all rows of a frame with the body's columns in one commit. A keyed type takes one row per key and refuses more."""
        base, floor, _ = self._state()
        with self._staged(rows, self.kind.body.fieldNames(), floor) as placed:
            if not self.kind.key:
                return self._commit(placed.withColumn("rec", F.lpad(F.col("instant").cast("string"), 20, "0")), F.lit(True), F.lit(False), base, F.lit(None).cast("string"))
            placed = placed.withColumn("rec", self._addresses())
            if not placed.groupBy("rec").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
                raise InvalidRecord(f"{self.kind.name}: a key stands in several rows")
            now = self.latest().select("rec", F.col("in_living").alias("__lives"), F.col("permission").alias("__permission"))
            return self._commit(placed.join(now, "rec", "left"), ~F.coalesce("__lives", F.lit(False)), F.lit(False), base, F.col("__permission"))

    def save(self, rec: str, **values) -> int:
        """A new version of a record. It does not bring a removed one back, and one that never was inserted stays out of the living."""
        if self.kind.key and self._keyed(values) != rec:
            raise KeyMismatch(rec)
        base, floor, now = self._state(rec)
        if now is None and self.kind.pivots:
            raise RecordMissing(rec)
        instant = mint(floor)
        self.store.apply(self._frame([self._row(rec, instant, False, values, removed=bool(now and now["removed"]), permission=now["permission"] if now else None)]), base=base)
        return instant

    def save_all(self, rows: DataFrame) -> int:
        """A new version of each record of a frame with rec and the body's columns, in one commit. Records that are not there, or stand in
        several rows, are refused, and nothing is written."""
        base, floor, _ = self._state()
        with self._staged(rows, ["rec", *self.kind.body.fieldNames()], floor) as placed:
            now = self.latest().select("rec", F.col("removed").alias("__removed"), F.col("permission").alias("__permission"))
            both = placed.join(now, "rec", "left")
            if not placed.groupBy("rec").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
                raise InvalidRecord(f"{self.kind.name}: a record stands in several rows")
            if not both.where("__removed is null").isEmpty():
                raise RecordMissing("a record to save is not there")
            if self.kind.key and not both.where(self._addresses() != F.col("rec")).isEmpty():
                raise KeyMismatch("a record's key is not that of its address")
            return self._commit(both, F.lit(False), F.col("__removed"), base, F.col("__permission"))

    def remove(self, rec: str) -> bool:
        """Whether a living record was removed. It is an event, not a version: the record's own instant stays."""
        base, floor, now = self._state(rec)
        if now is None or not now["in_living"]:
            return False
        gone = self.store.spark.createDataFrame([(self.session.tenant, self.pivot, rec, mint(floor))], "tenant long, pivot long, rec string, instant long")
        self.store.apply(removals=gone, base=base)
        return True

    def adopt(self, foreign: DataFrame, removals: DataFrame | None = None) -> int:
        """Mirrors another node's versions (and removals) verbatim, with their own instants and metadata, and leaves out those that are
        here already. One that lives here in another version becomes a chained version; a dead one is entered again by the
        foreign entry."""
        base = self._base()
        versions, here = self._log()
        fields = self.store.schema.fieldNames()
        # Versions are compared by all they hold, as another node may have written the same instant.
        mine = self.versions().select("tenant", "pivot", "rec", "instant", F.xxhash64(*fields).alias("h"))
        fresh = self._mine(foreign).withColumn("h", F.xxhash64(*fields)).join(mine, ["tenant", "pivot", "rec", "instant", "h"], "left_anti").drop("h")
        gone = None if removals is None else self._mine(removals).join(here, ["tenant", "pivot", "rec", "instant"], "left_anti").select("tenant", "pivot", "rec", "instant")
        if fresh.isEmpty() and (gone is None or gone.isEmpty()):
            return base
        return self.store.apply(fresh.select(*fields), gone, base=base)

    def adopt_records(self, living: DataFrame) -> int:
        """Mirrors another node's living records (rec and the body's columns, without metadata): new ones are inserted under their
        address, changed ones saved, dead ones revived, unchanged ones left alone."""
        base, floor, _ = self._state()
        fields = self.kind.body.fieldNames()
        now = self.latest().select("rec", F.col("in_living").alias("__lives"), F.col("permission").alias("__permission"), F.xxhash64(*fields).alias("__h"))
        changed = living.select("rec", *fields).join(now, "rec", "left").where(~F.coalesce(F.col("__lives") & (F.col("__h") == F.xxhash64(*fields)), F.lit(False)))
        if changed.isEmpty():
            return base
        with self._staged(changed, ["rec", *fields, "__lives", "__permission"], floor) as placed:
            return self._commit(placed, ~F.coalesce("__lives", F.lit(False)), F.lit(False), base, F.col("__permission"))


class UniqueRecord(_Handle):
    """The one record of a type that each tenant has."""

    REC = "unique"

    def __init__(self, kind: RecordType, store: LogStore, session: Session):
        if kind.shape is not Shape.UNIQUE:
            raise InvalidRecord(f"{kind.name} has many records per tenant")
        super().__init__(kind, store, session)

    def get(self) -> Row | None:
        return views.unique_latest(self.versions()).first()

    def latest(self) -> DataFrame:
        return views.unique_latest(self.versions())

    def save(self, **values) -> int:
        return self.save_as(self.session.user, **values)

    def save_as(self, author: int | None, **values) -> int:
        """A new version, written by author."""
        base, now = self._base(), self.get()
        instant = mint(now["instant"] if now else 0)
        row = self._row(self.REC, instant, now is None, values, permission=now["permission"] if now else None, author=author)
        self.store.apply(self._frame([row]), base=base)
        return instant

    def adopt(self, foreign: DataFrame) -> int:
        """Mirrors another node's versions verbatim; those that are here already are left out."""
        base = self._base()
        fields = self.store.schema.fieldNames()
        mine = self.versions().select("tenant", "pivot", "rec", "instant", F.xxhash64(*fields).alias("h"))
        fresh = self._mine(foreign).withColumn("h", F.xxhash64(*fields)).join(mine, ["tenant", "pivot", "rec", "instant", "h"], "left_anti").drop("h")
        return base if fresh.isEmpty() else self.store.apply(fresh.select(*fields), base=base)

    def history(self) -> DataFrame:
        """Live version first; empty if it was never saved."""
        return views.history(self.versions()).orderBy("ver")

    def changes(self, cursor: int | None = None) -> tuple[DataFrame, int]:
        """(versions missed, next cursor); an unknown cursor gives the live version alone."""
        now = self.get()
        live = now["instant"] if now else None
        cursors = self.store.spark.createDataFrame([(self.session.tenant, cursor)], "tenant long, cursor long")
        events = views.unique_changes(self.versions(), cursors).orderBy("instant")
        if live is None:
            return events, cursor or 0
        return events, live if cursor is None else max(cursor, live)

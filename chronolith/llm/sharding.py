"""Sharding through fixed virtual slots.

Records are hashed into a fixed number of slots, so a record's slot never changes. One aggregation gives the bytes
and rows of each slot (as many rows as there are slots, whatever the input), and a versioned slot-to-shard map says
where each slot lies. Rebalancing edits the map: single slots move from the fullest shard to the emptiest while that
brings the two nearer, so that bytes are near equal and few slots move. Adding a shard is an edit as well.

DataFrame functions alone touch records; the driver handles only the map, of slots entries.

Defined results: a null text counts as empty. Records with a null doc_id are hashed by their text. Equal rows share a
slot and get places one after the other. An empty table gives no rows. Other columns of the input are not read.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.llm._common import new_path, text_of

SLOTS = 8192
#: Bytes that a record takes beside its text.
RECORD_BYTES = 16


@dataclass(frozen=True)
class SlotMap:
    """Which shard each slot lies in. Edits give the next version."""

    version: int
    shards: int
    of_slot: tuple[int, ...]

    @classmethod
    def first(cls, shards: int, slots: int = SLOTS) -> SlotMap:
        return cls(1, shards, tuple(s % shards for s in range(slots)))

    def rebalanced(self, slot_bytes: list[int], shards: int | None = None, most_moves: int | None = None) -> SlotMap:
        """The next version over ``shards`` shards (at least as many as now): slots move, or change places, from the fullest shard to the emptiest while that narrows the gap."""
        shards = shards or self.shards
        if shards < self.shards:
            raise ValueError("shards can be added, not taken away")
        where = list(self.of_slot)
        held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
        for slot, shard in enumerate(where):
            if slot_bytes[slot]:
                held[shard].append((slot_bytes[slot], slot))
        for x in held:
            x.sort()
        load = [sum(b for b, _ in x) for x in held]
        for _ in range(most_moves if most_moves is not None else 4 * len(where)):
            full, bare = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
            gap = load[full] - load[bare]
            change = _narrowing(held[full], held[bare], gap)
            if change is None:
                break
            out, back = change
            for entry, a, b in ((out, full, bare), (back, bare, full)):
                if entry:
                    held[a].remove(entry)
                    bisect.insort(held[b], entry)
                    where[entry[1]] = b
                    load[a] -= entry[0]
                    load[b] += entry[0]
        return SlotMap(self.version + 1, shards, tuple(where))

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the maps under path."""
        rows = spark.range(len(self.of_slot)).select(F.lit(self.shards).alias("shards"), F.col("id").cast("int").alias("slot"), _entry(self.of_slot, F.col("id")).alias("shard"))
        rows.coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={self.version}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The version asked for, or the newest."""
        maps = spark.read.parquet(path)
        version = version if version is not None else maps.agg(F.max("version")).first()[0]
        rows = maps.where(F.col("version") == version).orderBy("slot").collect()
        return cls(version, rows[0]["shards"], tuple(r["shard"] for r in rows))


def _narrowing(full: list, bare: list, gap: int) -> tuple | None:
    """(slot that leaves the full shard, slot that comes back or None) that brings the gap nearest to nothing; None if nothing narrows it."""
    best, found = gap, None

    def consider(out: tuple, back: tuple | None) -> None:
        nonlocal best, found
        left = abs(gap - 2 * (out[0] - (back[0] if back else 0)))
        if left < best:
            best, found = left, (out, back)

    for wanted, back in [(gap // 2, None), *((gap // 2 + b[0], b) for b in bare)]:
        at = bisect.bisect_left(full, (wanted, -1))
        for entry in full[max(0, at - 1) : at + 1]:
            consider(entry, back)
        if best <= 1:
            break
    return found


def _entry(values: list[int] | tuple[int, ...], index: Column) -> Column:
    """values[index] for a set of values of the map's size: a constant that the optimiser folds into one array."""
    return F.element_at(F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>"), index.cast("int") + 1)


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of each record."""
    text = text_of()
    key = F.when(F.col("doc_id").isNull(), F.xxhash64(text)).otherwise(F.xxhash64("doc_id"))
    return docs.select("doc_id", (F.octet_length(text) + RECORD_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.pmod(key, F.lit(slots)).cast("int").alias("virtual_slot"))


def shard(docs: DataFrame, shards: int, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (place in its shard, gapless), grown_shard, virtual_slot, map_version.

    The law is ``bytes``: the map's first version deals slots out in turn, its second is edited by the slots' bytes.
    Both versions are stored under map_path (a new folder in the shared one by default).
    """
    spark, rows = docs.sparkSession, records(docs, slots)
    held = {r["virtual_slot"]: r for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
    slot_bytes = [held[s]["bytes"] if s in held else 0 for s in range(slots)]
    first, path = SlotMap.first(shards, slots), map_path or new_path(spark, "slot-map")
    first.save(spark, path)
    first.rebalanced(slot_bytes).save(spark, path)
    current = SlotMap.load(spark, path)
    base, used = [0] * slots, [0] * shards
    for s, to in enumerate(current.of_slot):
        base[s] = used[to]
        used[to] += held[s]["n"] if s in held else 0
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")) - 1
    at = F.col("virtual_slot")
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), _entry(current.of_slot, at).cast("int").alias("shard"),
        (_entry(base, at) + place).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(current.version).alias("map_version"),
    )

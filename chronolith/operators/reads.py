"""Reads over a living view (plans.views.living) or over latest versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.operators.bounds import All

#: Rows up to which a page is found by a heap of its offset and limit in each task.
SHALLOW = 10_000


def get(latest: DataFrame, address: Column) -> DataFrame:
    """A record by its address, removed or not."""
    return latest.where(address)


def anchors(ids: DataFrame, latest: DataFrame, key: list[str]) -> DataFrame:
    """ids with state: vacant, living or dead."""
    found = latest.select(*key, F.lit(True).alias("__there"), F.col("removed").alias("__removed"))
    state = F.when(F.col("__there").isNull(), "vacant").when(F.col("__removed"), "dead").otherwise("living")
    return ids.join(found, key, "left").select(*ids.columns, state.alias("state"))


def search_by(live: DataFrame, fields: tuple[str, ...], bound=None, tie: str = "rec", within: tuple[str, ...] = ("tenant",)) -> DataFrame:
    """The living within a bound of an index, with pos: their order by the fields, then by address, in each collection."""
    order = Window.partitionBy(*within).orderBy(*fields, tie)
    return live.where((bound or All()).predicate(fields)).withColumn("pos", F.row_number().over(order).cast("long"))


def listed(live: DataFrame, keys: tuple[str, ...], tie: str = "rec", offset: int = 0, limit: int | None = None) -> DataFrame:
    """A declared list from an offset on: ordered by its keys, then by address. Past the end, or with limit 0, nothing."""
    rows = live.orderBy(*keys, tie)
    rows = rows.offset(offset) if offset else rows
    return rows if limit is None else rows.limit(limit)


def listed_at_page(live: DataFrame, keys: tuple[str, ...], page: int, page_size: int, path: str, tie: str = "rec") -> DataFrame:
    """From the start of a page on, to the end, by way of a list stored at path: an offset without a limit would pass every row through one task."""
    return StoredList.write(live, keys, path, tie).page(page * page_size)


def list_len(live: DataFrame, within: tuple[str, ...] = ("tenant",)) -> DataFrame:
    """The exact count of the living in each collection."""
    return live.groupBy(*within).agg(F.count("*").alias("len"))


class StoredList:
    """A list written in order with each row's pos, for pages at any depth: a page reads the row groups that hold it.

    An ordinary offset costs as much as all rows before it. Here rows are range-partitioned by the keys and written with
    their place in their file; a file's first pos comes from the counts of the files before it, one row a file.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.files = spark.read.parquet(path)
        counts = self.files.groupBy("part").agg(F.count("*").alias("n"))
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a file
        self.bases = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), "n")

    @classmethod
    def write(cls, live: DataFrame, keys: tuple[str, ...], path: str, tie: str = "rec") -> StoredList:
        ordered = live.repartitionByRange(*keys, tie).sortWithinPartitions(*keys, tie)
        number = F.monotonically_increasing_id()
        placed = ordered.select("*", F.shiftright(number, 33).cast("int").alias("part"), number.bitwiseAND(F.lit((1 << 33) - 1)).alias("local"))
        placed.write.parquet(path)
        return cls(live.sparkSession, path)

    def page(self, offset: int, limit: int | None = None) -> DataFrame:
        """Rows offset to offset + limit (or to the end), with pos from 0. Which files hold them is known from one row a file."""
        limit = len(self) if limit is None else limit
        held = [r for r in self.bases.where((F.col("base") < offset + limit) & (F.col("base") + F.col("n") > offset)).collect()]
        found = F.lit(False)
        base = F.lit(None).cast("long")
        for r in held:
            here = F.col("part") == r["part"]
            found = found | (here & (F.col("local") >= offset - r["base"]) & (F.col("local") < offset + limit - r["base"]))
            base = F.when(here, F.lit(r["base"])).otherwise(base)
        return self.files.where(found).withColumn("pos", base + F.col("local")).drop("part", "local")

    def all(self) -> DataFrame:
        """Every row with its pos from 0; a file's first pos is joined from one row a file."""
        return self.files.join(F.broadcast(self.bases.select("part", "base")), "part").withColumn("pos", F.col("base") + F.col("local")).drop("part", "local", "base")

    def __len__(self) -> int:
        return self.files.count()

"""A version log on Parquet with atomic commits.

A commit writes its rows to data folders of its own and then publishes its manifest, ``commits/<number>.json``, which is the
point of durability: a reader sees the data of whole commits only, and data of a commit that did not come through is never
read. A manifest is written under another name and then moved to its own, which fails if that is taken and never shows a
part of it: of two writers that saw the same state one gets ``Conflict``, and nothing of its batch is visible. Paths go
through Hadoop's file systems. An object store whose rename is not atomic needs its manifests on a file system that has it.

With a commit's versions their postings are written, for the fuzzy indexes of the type. Pages carry checksums, which reads
verify. The first commit writes the type's head (name and columns); a store opened with another type refuses.
"""

from __future__ import annotations

import functools
import json
import math
import os
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolith.errors import Conflict, InvalidRecord
from chronolith.model import FuzzyIndex
from chronolith.operators import fuzzy

#: The body is stored as columns; a body of any type fits beside these.
VERSION_META = T.StructType([
    T.StructField("tenant", T.LongType(), False), T.StructField("pivot", T.LongType(), False), T.StructField("rec", T.StringType(), False),
    T.StructField("instant", T.LongType(), False), T.StructField("enters", T.BooleanType(), False), T.StructField("removed", T.BooleanType(), False),
    T.StructField("author", T.LongType()), T.StructField("device_created", T.LongType()), T.StructField("permission", T.StringType()),
])
REMOVAL = T.StructType([T.StructField(n, VERSION_META[n].dataType, False) for n in ("tenant", "pivot", "rec", "instant")])
PIVOT = T.StructType([T.StructField(n, T.LongType(), False) for n in ("tenant", "pivot")])
POSTING = T.StructType([T.StructField("field", T.StringType()), T.StructField("gram", T.StringType()), T.StructField("len", T.IntegerType()), *REMOVAL.fields])
KINDS = ("versions", "removals", "pivots", "postings")
#: Postings that a task sorts, whatever the commit's size and however few grams its texts have.
POSTINGS_PER_TASK = 1 << 20


@dataclass(frozen=True)
class Expect:
    """The record's live instant before the batch; None: it has no version."""

    tenant: int
    pivot: int
    rec: str
    instant: int | None


@dataclass(frozen=True)
class Commit:
    """The data folders of a commit. One that compacts stands for all up to its own."""

    number: int
    versions: str | None = None
    removals: str | None = None
    pivots: str | None = None
    postings: str | None = None
    compacts: bool = False


class LogStore:
    """One type's versions and removals under a folder. One writer at a time wins; readers need no lock."""

    def __init__(self, spark: SparkSession, path: str, body: T.StructType, fuzzy: tuple[FuzzyIndex, ...] = (), type_name: str | None = None):
        self.spark, self.path, self.body, self.fuzzy = spark, path.rstrip("/"), body, tuple(fuzzy)
        self.schema = T.StructType([*VERSION_META.fields, *body.fields])
        self._schemas = dict(zip(KINDS, (self.schema, REMOVAL, PIVOT, POSTING), strict=True))
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._head = json.dumps([type_name, body.simpleString()])
        self._known: dict[int, Commit] = {}  # manifests never change, so each is opened once
        self._check_head()

    def _hadoop(self, path: str):
        at = self._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self._conf), at

    def _text(self, path: str) -> str | None:
        fs, at = self._hadoop(path)
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _check_head(self) -> bool:
        """Whether the head is there; another type's is refused."""
        found = self._text(f"{self.path}/type.json")
        if found is not None and found != self._head:
            raise InvalidRecord(f"{self.path} holds {found}, not {self._head}")
        return found is not None

    def commits(self) -> list[Commit]:
        """All commits that count, in order: the last compaction and what came after it. New manifests alone are opened."""
        fs, at = self._hadoop(f"{self.path}/commits")
        if not fs.exists(at):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(at)]
        numbers = sorted(int(name[:-5]) for name in names if name.endswith(".json"))
        for number in numbers:
            if number not in self._known:
                text = self._text(f"{self.path}/commits/{number:012d}.json")
                if text is not None:  # else a compaction took it away meanwhile
                    self._known[number] = Commit(number, **json.loads(text))
        found = [self._known[n] for n in numbers if n in self._known]
        last = max((i for i, c in enumerate(found) if c.compacts), default=0)
        return found[last:]

    def _of(self, kind: str, upto: int | None) -> DataFrame:
        return self.read(kind, [c for c in self.commits() if upto is None or c.number <= upto])

    def versions(self, upto: int | None = None) -> DataFrame:
        return self._of("versions", upto)

    def removals(self, upto: int | None = None) -> DataFrame:
        return self._of("removals", upto)

    def pivots(self) -> DataFrame:
        """(tenant, pivot) of every collection that was created."""
        return self._of("pivots", None)

    def postings(self) -> DataFrame:
        """A row for each distinct gram of each version's indexed fields."""
        return self._of("postings", None)

    def read(self, kind: str, commits: list[Commit]) -> DataFrame:
        """What some commits hold."""
        folders = [f for c in commits if (f := getattr(c, kind))]
        if not folders:
            return self.spark.createDataFrame([], self._schemas[kind])
        return self.spark.read.schema(self._schemas[kind]).option("parquet.page.verify-checksum.enabled", "true").parquet(*[f"{self.path}/{f}" for f in folders])

    def _write(self, kind: str, frame: DataFrame, name: str) -> str:
        folder = f"{kind}/{name}"
        frame.write.options(**{"compression": "zstd", "parquet.page.write-checksum.enabled": "true"}).parquet(f"{self.path}/{folder}")
        return folder

    def _grams(self, versions: DataFrame) -> DataFrame | None:
        parts = [fuzzy.postings(versions, x.field, x.n, x.fold, ("tenant", "pivot", "rec", "instant")).withColumn("field", F.lit(x.field)).select(*POSTING.fieldNames()) for x in self.fuzzy]
        return functools.reduce(DataFrame.union, parts) if parts else None

    def _dealt(self, versions: DataFrame) -> DataFrame:
        """versions in as many partitions as their postings need; a partition that comes from a large file has too many."""
        windows = functools.reduce(lambda a, b: a + b, [F.coalesce(F.length(x.field) + x.n - 1, F.lit(0)).cast("long") for x in self.fuzzy])
        tasks = math.ceil((versions.agg(F.sum(windows)).first()[0] or 0) / POSTINGS_PER_TASK)
        return versions.repartition(tasks, "tenant", "pivot", "rec", "instant") if tasks > 1 else versions

    def apply(self, versions: DataFrame | None = None, removals: DataFrame | None = None, expects: list[Expect] = (), base: int | None = None, pivots: DataFrame | None = None) -> int:
        """Commits a batch whole, or raises Conflict and leaves nothing visible. base: the last commit the batch was planned on."""
        if base is None:
            seen = self.commits()
            base = seen[-1].number if seen else 0
        self._check(expects)
        number = base + 1
        name = f"{number:012d}-{uuid.uuid4().hex}"
        body = {kind: self._write(kind, frame, name) for kind, frame in (("versions", versions), ("removals", removals), ("pivots", pivots)) if frame is not None}
        if versions is not None and self.fuzzy:
            grams = self._grams(self._dealt(self.read("versions", [Commit(number, versions=body["versions"])])))
            body["postings"] = self._write("postings", grams.sortWithinPartitions("tenant", "field", "gram"), name)
        self._publish(number, body)
        return number

    def _put(self, path: str, text: str) -> bool:
        """Writes a small file whole or not at all; False if it is there already."""
        temporary = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        fs, at = self._hadoop(temporary)
        stream = fs.create(at, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        final = self._jvm.org.apache.hadoop.fs.Path(path)
        try:
            if fs.getScheme() == "file":
                # Hadoop's rename replaces local files; a second link to a file does not.
                os.link(at.toUri().getPath(), final.toUri().getPath())
                return True
            rename = self._jvm.org.apache.hadoop.fs.Options.Rename
            options = self.spark.sparkContext._gateway.new_array(rename, 1)
            options[0] = rename.NONE
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf).rename(at, final, options)
            return True
        except FileExistsError:
            return False
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        finally:
            if fs.exists(at):
                fs.delete(at, False)

    def _publish(self, number: int, body: dict) -> None:
        if not self._check_head():
            self._put(f"{self.path}/type.json", self._head)
            self._check_head()
        if not self._put(f"{self.path}/commits/{number:012d}.json", json.dumps(body)):
            raise Conflict(f"commit {number} is taken")

    def _check(self, expects: list[Expect]) -> None:
        if not expects:
            return
        wanted = {(e.tenant, e.pivot, e.rec): e.instant for e in expects}
        keys = self.spark.createDataFrame(list(wanted), "tenant long, pivot long, rec string")
        found = self.versions().join(F.broadcast(keys), ["tenant", "pivot", "rec"]).groupBy("tenant", "pivot", "rec").agg(F.max("instant").alias("instant"))
        have = {(r["tenant"], r["pivot"], r["rec"]): r["instant"] for r in found.collect()}
        for key, instant in wanted.items():
            if have.get(key) != instant:
                raise Conflict(f"{key}: expected {instant}, found {have.get(key)}")

    def compact(self) -> int:
        """Rewrites all commits as one, clustered by tenant and collection (postings by gram), so that reads prune; then takes the
        older manifests away. Their data stays for readers that hold them, until vacuum()."""
        seen = self.commits()
        number = (seen[-1].number if seen else 0) + 1
        name = f"{number:012d}-{uuid.uuid4().hex}"
        body: dict = {"compacts": True}
        order = ("tenant", "pivot", "rec", "instant")
        for kind in ("versions", "removals"):
            body[kind] = self._write(kind, self.read(kind, seen).repartitionByRange(*order[:3]).sortWithinPartitions(*order), name)
        body["pivots"] = self._write("pivots", self.read("pivots", seen).distinct().coalesce(1), name)
        if self.fuzzy:
            kept = self.read("postings", seen)
            tasks = max(1, math.ceil(kept.count() / POSTINGS_PER_TASK))
            # By address as well, as every text may have the same gram.
            dealt = kept.repartitionByRange(tasks, "tenant", "field", "gram", "pivot", "rec", "instant")
            body["postings"] = self._write("postings", dealt.sortWithinPartitions("tenant", "field", "gram"), name)
        self._publish(number, body)
        for c in seen:
            fs, at = self._hadoop(f"{self.path}/commits/{c.number:012d}.json")
            fs.delete(at, False)
        return number

    def vacuum(self, older_than_seconds: float = 7 * 86_400) -> int:
        """Deletes data folders that no commit names and that have not been written to for so long; how many."""
        held = {getattr(c, kind) for c in self.commits() for kind in KINDS}
        gone, before = 0, (time.time() - older_than_seconds) * 1000
        for kind in KINDS:
            fs, at = self._hadoop(f"{self.path}/{kind}")
            for status in fs.listStatus(at) if fs.exists(at) else ():
                if f"{kind}/{status.getPath().getName()}" not in held and status.getModificationTime() < before:
                    fs.delete(status.getPath(), True)
                    gone += 1
        return gone

    def stream(self, files_per_batch: int = 64) -> DataFrame:
        """The commits as a stream of manifests, in order: nothing that was not committed is in it."""
        fs, at = self._hadoop(f"{self.path}/commits")
        fs.mkdirs(at)
        manifests = self.spark.readStream.schema(", ".join(f"{k} string" for k in KINDS) + ", compacts boolean")
        found = manifests.option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", files_per_batch).json(f"{self.path}/commits")
        return found.select("*", F.regexp_extract("_metadata.file_name", r"(\d+)", 1).cast("long").alias("number"))

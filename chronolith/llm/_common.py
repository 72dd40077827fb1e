"""Helpers that the operators share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What is broadcast has at most so many rows and bytes, far below any executor's memory.
BROADCAST_ROWS, BROADCAST_BYTES = 300_000, 8 << 20
#: Bytes of rows that a Python worker gets at once.
ARROW_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where that is unset, and the one machine is the whole cluster, a new temporary one."""
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    have = spark.sparkContext.getCheckpointDir()
    if have is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="chronolith-"))
        have = spark.sparkContext.getCheckpointDir()
    return have.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Has Spark hand Python workers a few MB of rows at a time, however long the texts, unless the session says otherwise."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext.getConf().get(name, None) is None:
        spark.conf.set(name, ARROW_BYTES)


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/chronolith-{kind}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """The same few rows, materialised in the shared folder. Spark deletes them with the last frame that refers to them if
    spark.cleaner.referenceTracking.cleanCheckpoints is set, and else whoever clears the folder."""
    shared_dir(df.sparkSession)
    with released_shuffles(df.sparkSession):
        return df.checkpoint(eager=True)


@contextlib.contextmanager
def released_shuffles(spark: SparkSession):
    """Within, shuffle files of an execution go when it ends and not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Scratch:
    """Intermediate tables of one run of an operator: Parquet in a folder of the shared one, each deleted by name when it has served."""

    def __init__(self, spark: SparkSession, kind: str):
        self.spark, self.path = spark, new_path(spark, kind)

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """df, written and read back."""
        with released_shuffles(self.spark):
            df.write.mode("errorifexists").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.path}/{name}")

    def close(self) -> None:
        """Deletes what is left."""
        delete(self.spark, self.path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint for df if it was measured to have at most so many rows and bytes, else df as it is, which joins by shuffling."""
    width = F.lit(8 * len(df.columns)).cast("long")
    for f in df.schema.fields:
        if not isinstance(f.dataType, (T.NumericType, T.BooleanType)):
            width = width + F.coalesce(F.octet_length(F.col(f.name).cast("string")), F.lit(0))
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(width).alias("bytes")).first()
    return F.broadcast(df) if found["n"] <= rows and (found["bytes"] or 0) <= most else df


def text_of(col: str = "text"):
    """The text; null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))

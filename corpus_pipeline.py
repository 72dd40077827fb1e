"""A corpus pipeline: quality rules, near-duplicates, repeated passages, the mix of sources, packing.

Each stage works on all that the one before kept; all but the last return the columns of documents.

Defined results: rows with one doc_id and different texts are documents of their own, and rows without a doc_id as well. A
null text counts as empty: quality rules reject it, as they do an empty one. Very long texts pass every stage whole.
Equal rows are judged alike; near-duplicates keep one of them. Ties go by doc_id, then by a hash of the text. An empty
table gives an empty table in every stage. Columns beside those of documents are not read, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.llm import mixing, near_dedup, packing, quality_rules, suffix_dedup
from chronolith.llm._common import bounded_batches, delete, new_path, table, text_of

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    rejected = quality_rules.judge(docs.select(*COLUMNS, F.xxhash64(text_of()).alias("tie")), keep=("tie",)).where("not kept")
    rejected = rejected.select(F.col("doc_id").alias("r"), F.col("tie").alias("t")).distinct()
    gone = F.col("doc_id").eqNullSafe(F.col("r")) & (F.xxhash64(text_of()) == F.col("t"))
    return docs.select(*COLUMNS).join(rejected, gone, "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the least doc_id, documents without an id coming last; of equal rows one stays."""
    bounded_batches(spark)
    kept = near_dedup.classes(docs).where("first").select(F.col("doc_id").alias("k"), F.col("tie").alias("t")).distinct()
    named = docs.select(*COLUMNS, F.xxhash64(text_of()).alias("tie"))
    stays = named.join(kept, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("tie") == F.col("t")), "left_semi")
    nth = F.row_number().over(Window.partitionBy("doc_id", "tie").orderBy("source", "lang"))
    return stays.withColumn("nth", nth).where("nth = 1").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of strings that also start earlier; characters of which only a part is left are dropped."""
    bounded_batches(spark)
    rest = suffix_dedup.dedup(docs.select(*COLUMNS), keep=("lang", "source", "n_chars"))
    return rest.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    same = F.xxhash64(text_of(), F.coalesce("source", F.lit("")), F.col("source").isNull())
    plan = mixing.plan(docs.select(*COLUMNS, same.alias("tie")), keep=("tie",))
    times = plan.groupBy("doc_id", "tie").agg(F.sum("repeats").alias("times")).where("times > 0").select(F.col("doc_id").alias("p"), F.col("tie").alias("t"), "times")
    first = F.row_number().over(Window.partitionBy("doc_id", "tie").orderBy("lang"))
    rows = docs.select(*COLUMNS, same.alias("tie")).withColumn("nth", first).where("nth = 1")
    taken = rows.join(times, F.col("doc_id").eqNullSafe(F.col("p")) & (F.col("tie") == F.col("t")))
    return taken.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences, with their ids."""
    bounded_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality), ("near-duplicates", near_duplicates), ("repeated passages", repeated_passages), ("mix of sources", mix), ("packing", pack)]

#: Alignment, suffix arrays and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each is written to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), new_path(spark, "corpus-pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            delete(spark, f"{folder}/{k - 1}")
    return docs

"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its weight's share of all words, at most ``cap`` times its own size; what is cut off is shared
again by weight. Complete epochs come first: every document of the source is taken floor(target / size) times. The
rest of the target is a fractional selection: documents are sorted by exponential keys, -ln(u) / quality, with u from
a hash of doc_id and a seed, and taken while the prefix sum of their sizes stays within the rest; one more document,
the largest that still fits, brings the sum near the target.

Prefix sums scale: keys fall in buckets by their logarithm, so many to a doubling that, whatever the qualities, a bucket
holds about one row in 8,000 of a source at most; the buckets' sums (one row per source and bucket) find the one that the
rest ends in, and only that bucket's rows are ordered. A hot source is never in one task.

Defined results: a null text has size 0. A null source is a source of its own, last. Documents of size 0 are selected
with their bucket's prefix but take no words. Rows with one doc_id have one key and are told apart by their row.
Reruns on the same files agree. An empty table gives no rows. Extra columns are kept by mix(), ignored by plan().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.llm._common import cut, small, text_of

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code-point order, repeated.
WEIGHTS = (1, 2, 3)
#: Buckets of keys to a doubling, of which there are 80; a bucket's rows are ordered in one task.
BUCKETS = 2048


def words(col: Column) -> Column:
    return F.size(F.regexp_extract_all(col, F.lit(WORD), F.lit(0))).cast("long")


def quality(size: Column, chars: Column) -> Column:
    """Weight of a document in (0, 1]: highest where the characters per word are near those of prose."""
    mean = chars / F.greatest(size, F.lit(1))
    return 1 / (1 + F.abs(mean - 6.5) / 6.5)


def uniform(seed: int) -> Column:
    """In (0, 1], from 52 bits of the md5 of doc_id and the seed."""
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f"|{seed}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 1) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3) -> DataFrame:
    """From (source, source_size): target, epochs and rest. One row per source, so its windows are small."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    place = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = sizes.withColumn("w", F.element_at(F.lit(list(weights)), (place + 1).cast("int")).cast("double")).withColumn("ratio", cap * F.col("source_size") / F.col("w"))
    # A source is cut off at the cap if its ratio is at most the level that is left once those of smaller ratio are.
    # The first that is not has the largest level of those that are not, and that level holds for all of them.
    level = (F.sum("source_size").over(everything) - F.coalesce(cap * F.sum("source_size").over(by_ratio), F.lit(0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(by_ratio), F.lit(0.0)))
    levels = ranked.withColumn("level", level).withColumn("capped", F.col("ratio") <= F.col("level"))
    last = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    target = F.when(F.col("capped"), (cap * F.col("source_size")).cast("double")).otherwise(F.col("w") * last)
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(cap))).otherwise(0).cast("long")
    return levels.select("source", "source_size", target.alias("target")).withColumn("epochs", epochs).withColumn("rest", F.greatest(F.floor(F.col("target") - F.col("epochs") * F.col("source_size")), F.lit(0)).cast("long"))


def plan(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, cap: int = 3, buckets: int = BUCKETS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, repeats (times it is taken), taken (words), and the columns in keep."""
    text = text_of()
    sized = docs.select(*keep, "doc_id", "source", words(text).alias("size"), F.length(text).alias("chars"))
    key = -F.log(uniform(seed)) / quality(F.col("size"), F.col("chars"))
    keyed = sized.select(*keep, "doc_id", "source", "size", key.alias("key"), F.monotonically_increasing_id().alias("row"))
    octave = F.least(F.log2(F.greatest(F.col("key"), F.lit(2.0**-40))) + 40, F.lit(80.0))
    keyed = cut(keyed.withColumn("bucket", F.floor(octave * buckets).cast("int")))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    by_source = cut(targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, cap))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = small(by_source.where("rest > 0").select(F.col("source").alias("s"), "rest"))
    run = sums.join(ends, F.col("source").eqNullSafe(F.col("s"))).withColumn("before", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    cuts = run.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("bucket_size"))).select(F.col("source").alias("s"), F.col("bucket").alias("cut_bucket"), (F.col("rest") - F.col("before")).alias("left"))
    cuts = small(cut(cuts))
    rows = keyed.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size", "row")
    ended = rows.where("bucket = cut_bucket").withColumn("upto", F.sum("size").over(order))
    inside = cut(ended.where("upto <= left").select("source", "row", "size", "left"))
    gaps = ended.groupBy("source").agg(F.max("left").alias("gap"), F.sum(F.when(F.col("upto") <= F.col("left"), F.col("size")).otherwise(0)).alias("got")).select(F.col("source").alias("s"), (F.col("gap") - F.col("got")).alias("gap"))
    free = rows.where("bucket >= cut_bucket").join(inside.select("row"), "row", "left_anti").join(small(cut(gaps)), F.col("source").eqNullSafe(F.col("s"))).where("size > 0 and size <= gap")
    fill = free.groupBy("source").agg(F.min(F.struct((-F.col("size")).alias("size"), "key", "doc_id", "row")).alias("best")).select("best.row")
    chosen = inside.select("row").unionByName(fill.select("row")).withColumn("picked", F.lit(1))
    result = rows.join(chosen, "row", "left").join(small(by_source.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s")))
    picked = F.when(F.col("bucket") < F.col("cut_bucket"), 1).otherwise(F.coalesce(F.col("picked"), F.lit(0)))
    repeats = F.when(F.col("cut_bucket").isNull(), F.col("epochs")).otherwise(F.col("epochs") + picked)
    return result.select(*keep, "doc_id", "source", "size", "source_size", "target", repeats.alias("repeats"), (repeats * F.col("size")).alias("taken"))

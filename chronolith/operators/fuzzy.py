"""Fuzzy search over one text field of the living.

Candidates share a gram with the query (at least as many as the mode's threshold needs); what is left is verified with
the exact measure, ranked, and cut to the limit. ``search`` reads the texts; ``search_postings`` reads a table of
postings, one row per distinct gram of a record, from which the query's few grams select by pushed-down filters.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.functions import Fold, containment, edit_distance, grams, jaccard, key_length, length_gap, let, normalize


@dataclass(frozen=True)
class Distance:
    """At most k edits."""

    k: int


@dataclass(frozen=True)
class Similarity:
    """Jaccard similarity of grams at least t."""

    t: float


@dataclass(frozen=True)
class Contains:
    """Share of the query's grams that the record has at least t."""

    t: float


Mode = Distance | Similarity | Contains


def threshold(mode: Mode, total: int, n: int) -> int:
    """How many of the query's grams a record must share."""
    if isinstance(mode, Distance):
        return max(0, total - n * mode.k)
    return min(max(math.ceil(min(max(mode.t, 0.0), 1.0) * total), 1), total)


def _total(query: str, n: int, fold: Fold, frame: DataFrame) -> tuple[str, list[str]]:
    """The normalised query and its grams, by the same expressions that records go through."""
    row = frame.sparkSession.range(1).select(normalize(F.lit(query), fold).alias("q")).select("q", grams(F.col("q"), n).alias("g")).first()
    return row["q"], row["g"]


def _verified(frame: DataFrame, field: str, mode: Mode, text: str, query_grams: list[str], least: int, n: int, fold: Fold) -> DataFrame:
    """frame with score and rank, where at least so many grams are shared and the mode holds."""
    q, g = F.lit(text), F.lit(query_grams)

    def score(normal: Column, own: Column) -> Column:
        enough = F.size(F.array_intersect(own, g)) >= least
        if isinstance(mode, Distance):
            return F.when((length_gap(normal, q) <= mode.k) & enough, edit_distance(q, normal, mode.k).cast("double"))
        measure = jaccard if isinstance(mode, Similarity) else containment
        return let(F.when(enough, measure(g, own)), lambda s: F.when(s >= mode.t, s))

    found = let(normalize(F.col(field), fold), lambda normal: let(grams(normal, n), lambda own: score(normal, own)))
    # What a generator makes is made once, and a filter on it stays above it: pushed down, it would measure every text below a join.
    scored = frame.select(*[c for c in frame.columns if c != "score"], F.explode_outer(F.array(found)).alias("score")).where("score is not null")
    return scored.withColumn("rank", F.col("score") if isinstance(mode, Distance) else 1 - F.col("score"))


def search(live: DataFrame, field: str, query: str, mode: Mode, limit: int | None = None, n: int = 3, fold: Fold = Fold.LATIN, tie: str = "rec", exhaustive: bool = False) -> DataFrame:
    """live with score and rank, best first, ties by address. A record that shares no gram is found only if exhaustive."""
    text, query_grams = _total(query, n, fold, live)
    least = threshold(mode, len(query_grams), n)
    found = _verified(live.where(F.col(field).isNotNull()), field, mode, text, query_grams, least if exhaustive else max(least, 1), n, fold).orderBy("rank", tie)
    return found if limit is None else found.limit(limit)


def postings(live: DataFrame, field: str, n: int = 3, fold: Fold = Fold.LATIN, key: tuple[str, ...] = ("tenant", "pivot", "rec")) -> DataFrame:
    """gram, len and the address: one row per distinct gram of each record. Written clustered by gram, lookups prune to few row groups."""
    normal = live.where(F.col(field).isNotNull()).select(*key, normalize(F.col(field), fold).alias("normal"))
    # For explode() the optimizer adds a filter that cuts each text once more; for explode_outer() it does not.
    return normal.select(F.explode_outer(grams(F.col("normal"), n)).alias("gram"), key_length(F.col("normal")).alias("len"), *key).where("gram is not null")


def candidates(index: DataFrame, query: str, mode: Mode, n: int = 3, fold: Fold = Fold.LATIN, key: tuple[str, ...] = ("tenant", "pivot", "rec")) -> DataFrame:
    """The addresses that share enough of the query's grams: only postings of those grams, and of a fitting length, are read."""
    text, query_grams = _total(query, n, fold, index)
    hits = index.where(F.col("gram").isin(query_grams))
    if isinstance(mode, Distance):
        hits = hits.where(F.abs(F.col("len") - min(len(text), 255)) <= mode.k)
    return hits.groupBy(*key).agg(F.count("*").alias("shared")).where(F.col("shared") >= threshold(mode, len(query_grams), n)).drop("shared")


def search_postings(index: DataFrame, live: DataFrame, field: str, query: str, mode: Mode, limit: int | None = None, n: int = 3, fold: Fold = Fold.LATIN, key: tuple[str, ...] = ("tenant", "pivot", "rec"), tie: str = "rec") -> DataFrame:
    """The same as search, from postings: what they name is fetched and verified."""
    return search(live.join(candidates(index, query, mode, n, fold, key), list(key), "left_semi"), field, query, mode, limit, n, fold, tie)

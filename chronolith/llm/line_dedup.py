"""Substring dedup by hashing of lines and sentences.

A text is cut into lines, its lines into sentences, and sentences that run over line breaks (up to a blank line) are units
as well. A unit is normalised (letters lower-cased, runs of characters that are neither letters nor digits made one space)
and digested. Digests are grouped globally, whatever unit they are of: the occurrence with the smallest (doc_id, place)
stays and every later one is removed, with its code-point offsets in the original text retained. Units with fewer than
``min_words`` words are never removed by themselves, since they repeat by chance; what stands between two removed units
and has fewer words than that in each line is removed with them, as it is part of a repeated passage. For the same reason
a run of repeated units, one after the other, is removed only if it has at least ``min_run`` words in all: a repeated
short line or sentence among new text stays. The sentences that a repeated passage begins and ends within stay. In
scripts without spaces two letters count as a word.

The first occurrence of a digest comes from an aggregation with partial minima, so a unit that stands in a third of
all documents moves as one row per task. Its row is joined back by digest, which adaptive execution splits if skewed.

Defined results: a null text counts as empty and has no lines removed. Null doc_ids rank last. Equal rows (same doc_id,
same text) count as one document, once. An empty table gives no rows. Extra columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolith.llm._common import cut, text_of

#: Words of the shortest unit that is digested, and of the shortest run of units that is removed.
MIN_WORDS, MIN_RUN = 5, 20

_APART = re.compile(r"[\W_]+")
_WORD = re.compile(r"[^\W_]")
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
#: Ends of sentences, and blank lines.
_END = re.compile(r"[.!?…]+[\"'”’»)\]]*(?=\s|$)|[。！？]+[」』”’）]*")
_BLANK = re.compile(r"\n[^\S\n]*(?=\n)")


def normalised(part: str) -> str:
    return _APART.sub(" ", part.lower()).strip()


def n_words(text: str) -> int:
    """Words of a text; two letters of Thai, Lao, Burmese, Khmer, kana or Han are one."""
    return len(text.split()) + (0 if text.isascii() else len(_UNSPACED.findall(text)) // 2)


def _long(norm: str, min_words: int) -> bool:
    return norm.count(" ") + 1 >= min_words or n_words(norm) >= min_words


def units(text: str, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, int, str]]:
    """place (of a line; -1: a sentence), start, end and normal form of the lines and sentences that are long enough."""
    at = 0
    for place, line in enumerate(text.split("\n")):
        ends = [m.end() for m in _END.finditer(line)]
        cuts = [0, *ends, len(line)]
        norms = [normalised(line[x:y]) for x, y in zip(cuts, cuts[1:])]
        several = sum(map(bool, norms)) > 1
        whole = " ".join(filter(None, norms)) if several else next(filter(None, norms), "")
        if _long(whole, min_words):
            yield place, at, at + len(line), whole
            if several:
                for x, y, norm in zip(cuts, cuts[1:], norms):
                    if _long(norm, min_words):
                        yield -1, at + x, at + y, norm
        at += len(line) + 1
    # Sentences over line breaks: from one end or blank line to the next end.
    start, blanks = 0, [m.end() for m in _BLANK.finditer(text)]
    for m in _END.finditer(text):
        while blanks and blanks[0] <= m.start():
            start = max(start, blanks.pop(0))
        part = text[start : m.end()]
        if "\n" in part.strip():
            norm = normalised(part)
            if _long(norm, min_words):
                yield -1, start + len(part) - len(part.lstrip()), m.end(), norm
        start = m.end()


def cells_of(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, version (a hash of the text), head (place of the first letter or digit), place, start, end and digest of every unit that is long enough."""
    base = docs.select("doc_id", text_of().alias("text")).select("doc_id", F.xxhash64("text").alias("version"), "text")
    names, kinds = ["head", "place", "start", "end"], [pa.int32()] * 4

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, columns, digests = [], [[], [], [], []], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for place, start, end, norm in units(text, min_words):
                    rows.append(i)
                    for column, x in zip(columns, (_WORD.search(text, start).start(), place, start, end), strict=True):
                        column.append(x)
                    digests.append(hashlib.sha256(norm.encode("utf-8", "surrogatepass")).digest()[:16])
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("version").take(at), *map(pa.array, columns, kinds), pa.array(digests, pa.binary())], names=["doc_id", "version", *names, "digest"])

    key = docs.schema["doc_id"].dataType
    fields = [T.StructField("doc_id", key), T.StructField("version", T.LongType()), *(T.StructField(n, T.IntegerType()) for n in names), T.StructField("digest", T.BinaryType())]
    return base.mapInArrow(made, T.StructType(fields))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, min_run: int = MIN_RUN) -> DataFrame:
    """One row per document: doc_id, text (what is kept), n_lines, n_removed, n_removed_chars and removed: its removed lines
    and parts of lines as (start, length, first_doc), in code points of the original text; first_doc is null for what is short and stands between."""
    cells = cells_of(docs, min_words)
    owner = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "version", "head")
    first = cells.groupBy("digest").agg(F.min(owner).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = cut(first.select("digest", F.col("first.doc_id").alias("first_doc"), F.col("first.version").alias("first_version"), F.col("first.head").alias("first_head")))
    own = F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("version") == F.col("first_version")) & (F.col("head") == F.col("first_head"))
    hits = cells.join(first, "digest").where(~own).groupBy("doc_id", "version").agg(F.collect_set(F.struct("place", "start", "end", "first_doc")).alias("hits"))
    hits = hits.select(F.col("doc_id").alias("hit_doc"), F.col("version").alias("hit_version"), "hits")
    base = docs.select("doc_id", text_of().alias("text")).withColumn("version", F.xxhash64("text"))
    both = base.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_doc")) & (F.col("version") == F.col("hit_version")), "left")
    key = docs.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("doc_id", key), T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_removed_chars", T.LongType()),
        T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("first_doc", key)]))),
    ])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            kinds = [kind, pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("first_doc", kind)]))]
            done = [(d, *removal(t, [x for x in h or () if x["place"] >= 0], min_words, [x for x in h or () if x["place"] < 0], min_run)) for d, t, h in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "hits")), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True) if done else [[]] * 6, kinds, strict=True)], names=schema.names)

    return both.select("doc_id", "text", "hits").mapInArrow(assemble, schema)


def removal(text: str, hits: list[dict] | None, min_words: int, spans: list[dict] = (), min_run: int = 0) -> tuple[str, int, int, int, list[dict]]:
    """What dedup() returns of a text, from its removed lines (by place) and sentences (by start and end)."""
    parts = text.split("\n")
    firsts = {h["place"]: h["first_doc"] for h in hits or ()}
    starts, at = [], 0
    for part in parts:
        starts.append(at)
        at += len(part) + 1
    # What repeats in each line, as (start, end, first_doc) in the line, in order and apart.
    again: dict[int, list[tuple]] = {i: [(0, len(parts[i]), first)] for i, first in firsts.items()}
    for span in sorted(spans, key=lambda x: (x["start"], -x["end"])):
        i = bisect_right(starts, span["start"]) - 1
        while i < len(parts) and starts[i] < span["end"]:
            mine = again.setdefault(i, [])
            x, y = max(span["start"] - starts[i], mine[-1][1] if mine else 0), min(span["end"] - starts[i], len(parts[i]))
            if x < y:
                mine.append((x, y, span["first_doc"]))
            i += 1
    gone: dict[int, list[tuple]] = {}
    run: list[tuple] = []  # (line, start, end, first_doc) of what repeats, and of what is short between
    waiting: list[tuple] = []  # the same of what is short since then

    def settle() -> None:
        if sum(n_words(parts[i][x:y]) for i, x, y, _ in run) >= min_run:
            for i, x, y, first in run:
                gone.setdefault(i, []).append((x, y, first))
        run.clear()
        waiting.clear()

    for i, part in enumerate(parts if again else ()):
        at = 0
        for x, y, first in [*again.get(i, ()), (len(part), len(part), None)]:
            if at < x or not part:
                if n_words(part[at:x]) < min_words:
                    waiting.append((i, at, x, None))
                else:
                    settle()
            if x < y:
                if run:
                    run += waiting
                waiting.clear()
                run.append((i, x, y, first))
            at = y
    settle()
    kept, removed = [], []
    for i, part in enumerate(parts):
        mine = sorted(gone.get(i, ()), key=lambda r: r[:2])
        removed += [{"start": starts[i] + x, "length": y - x, "first_doc": first} for x, y, first in mine if x < y or len(part) == 0]
        rest, at = [], 0
        for x, y, _ in mine:
            rest.append(part[at:x])
            at = y
        left = "".join([*rest, part[at:]])
        # A line of which nothing is left goes with its line break.
        if not mine or left.strip():
            kept.append(left)
    return "\n".join(kept), len(parts), len(removed), sum(r["length"] for r in removed), removed

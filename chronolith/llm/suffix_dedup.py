"""Exact substring dedup over all documents, by suffix arrays of the places that can repeat.

A byte is removed if it is covered by a string of ``LENGTH`` bytes that also starts earlier: in a document of smaller
doc_id, or earlier in its own. Strings are judged on the input.

A text that an earlier document has as well is removed whole. Of distinct texts:

1. Anchors: in each string of LENGTH bytes the leftmost GRAM bytes of least hash. Equal strings have equal anchors at
   equal offsets, so a string repeats only if its anchor does. Around an anchor, a context holds every string of LENGTH
   bytes that contains it. Anchors are dealt by their hash once; those that stand in one place alone go.
2. Equal contexts of an anchor are one, that of the earliest place: in the others every string starts earlier too.
3. Distinct contexts of one anchor go to one task, which trims the margins that no other of them shares, makes what has
   become equal one, and sorts the suffixes of the rest by linear grouping (suffix_array.py). Of suffixes that agree in LENGTH bytes the earliest start
   stays; the others are removed.
4. Anchors with more than LIMIT distinct contexts are refined until they have fewer: of the bytes of a string beside its
   anchor, half lie on one side. So each context gives one with the anchor longer by half of what is missing on the
   right, and one on the left; every string lies in one of the two, and steps 2 and 3 hold for the longer anchors. After
   at most seven refinements an anchor is the whole string, and has one context.
5. Removed strings of a document are merged into spans.

A context that its own text has earlier goes at once, so an anchor has a row for each text and context at most. One that
stands in a third of all documents is one of the many of each, so no task gets more than a few times its share of rows. Intermediate tables are written in the shared folder and deleted when they have served.

Defined results: a null text counts as empty. Null doc_ids rank last, by a 64-bit hash of their text. Rows with one doc_id
but other texts rank by that hash; equal rows count as one document. A doc_id that is not a number is an error. An empty
table gives no rows. Columns of the input are read only if named in keep; their names cannot clash with the operator's.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolith.llm._common import Scratch, cut, small, text_of
from chronolith.llm.suffix_array import suffix_array

LENGTH, GRAM = 100, 24
#: Distinct contexts of an anchor that one suffix array may hold.
LIMIT = 1000
#: Bytes whose anchors are sought at once; a longer text is taken in overlapping pieces.
BLOCK = 1_000_000
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_PLACE_BITS = 24


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, and a number for each byte."""
    up, down = np.full(n, _BASE, dtype=np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down), np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(32))


class Hashes:
    """64-bit hashes of all substrings of uint8 data: differences of one running sum."""

    def __init__(self, data: np.ndarray):
        up, self.down, numbers = _powers(max(1 << 20, 1 << len(data).bit_length()))
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(numbers[data] * up[: len(data)], out=self.sums[1:])

    def every(self, size: int) -> np.ndarray:
        """Of the bytes of a size that begin at each place."""
        n = len(self.sums) - size
        return _mixed((self.sums[size:] - self.sums[:n]) * self.down[:n])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]


def anchors(hashes: Hashes, starts: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the anchors of data, texts of which begin at starts; ascending places."""
    n = len(hashes.sums) - 1
    if n < length:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    whole = hashes.every(gram)
    m = len(whole)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    best = (whole & ~low) | np.arange(m, dtype=np.uint64)
    window, reach = length - gram + 1, 1
    while 2 * reach <= window:
        best = np.minimum(best[:-reach], best[reach:])
        reach *= 2
    if reach < window:
        best = np.minimum(best[: -(window - reach)], best[window - reach :])
    # A string that begins at i lies in one text if no text begins in the length - 1 bytes after i.
    inside = np.ones(len(best), dtype=bool)
    for s in starts[1:].tolist():
        inside[max(0, s - length + 1) : s] = False
    chosen = np.zeros(m, dtype=bool)
    chosen[(best[inside] & low).astype(np.int64)] = True
    places = np.flatnonzero(chosen)
    return places, whole[places].view(np.int64)


def _blocks(texts: list[bytes], length: int) -> Iterator[tuple[list[tuple[int, int]], bytes]]:
    """Bytes to look for anchors in at once, with (text, offset in it) of each part."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), BLOCK):
            part = text[at : at + BLOCK + length - 1]
            if held and size + len(part) > BLOCK:
                yield [(j, a) for j, a, _ in held], b"".join(p for *_, p in held)
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
    if held:
        yield [(j, a) for j, a, _ in held], b"".join(p for *_, p in held)


def text_anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, place in it, hash, hash of its context, end of its context) of all anchors, block by block; a place may come twice where pieces of a text overlap."""
    all_sizes, reach = np.array([len(t) for t in texts], dtype=np.int64), length - gram
    for parts, data in _blocks(texts, length):
        sizes = [min(len(texts[i]) - at, BLOCK + length - 1) for i, at in parts]
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        hashes = Hashes(np.frombuffer(data, dtype=np.uint8))
        places, h = anchors(hashes, starts, length, gram)
        # Empty texts share a start with the next; the last part that begins there is the one with bytes.
        part = np.searchsorted(starts, places, "right") - 1
        text, offset = np.array([i for i, _ in parts], dtype=np.int64)[part], np.array([at for _, at in parts], dtype=np.int64)[part]
        place = places - starts[part] + offset
        left, end = np.minimum(place, reach), np.minimum(place + length, all_sizes[text])
        # A context that a piece of a long text cuts off is hashed from the text.
        begins, ends = places - left, places + end - place
        cut_off = (begins < starts[part]) | (ends > starts[part] + np.array(sizes, dtype=np.int64)[part])
        c = hashes.of(np.where(cut_off, 0, begins), np.where(cut_off, 0, ends))
        for k in np.flatnonzero(cut_off).tolist():
            whole = texts[text[k]][place[k] - left[k] : end[k]]
            c[k] = Hashes(np.frombuffer(whole, dtype=np.uint8)).of(np.array([0]), np.array([len(whole)]))[0]
        # The anchor's place in a context that is cut off at the text's start or end tells it apart.
        c = _mixed(c + ((left << 8) + (end - place)).astype(np.uint64) * _MIX)
        yield text, place, h, c.view(np.int64), end


def context(text: bytes, place: int, length: int, gram: int) -> tuple[bytes, bytes]:
    """The bytes left of the anchor and from it on that strings of the length reach."""
    return text[max(0, place - (length - gram)) : place], text[place : place + length]


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [b"" if x is None else x for x in batch.column("text").cast(pa.binary()).to_pylist()]


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def later(group: list[tuple], length: int = LENGTH) -> list[tuple]:
    """Of the distinct contexts of one anchor - (key, place, left, right), the key being what ranks documents - the removed
    strings as (key, start, end)."""
    # Margins that a context shares with some other: with a neighbour in the order of right sides, and of turned left sides.
    shared = [[0, 0] for _ in group]
    for side, texts in ((0, [g[2][::-1] for g in group]), (1, [g[3] for g in group])):
        order = sorted(range(len(group)), key=texts.__getitem__)
        for x, y in zip(order, order[1:], strict=False):
            c = _common(texts[x], texts[y])
            shared[x][side] = max(shared[x][side], c)
            shared[y][side] = max(shared[y][side], c)
    # Equal rests are one, that of the earliest place; the others go whole.
    merged: dict[bytes, list[tuple]] = {}
    for (key, place, left, right), (on_left, on_right) in zip(group, shared, strict=True):
        if on_left + on_right >= length:
            merged.setdefault(left[len(left) - on_left :] + right[:on_right], []).append((key, place - on_left))
    removed = []
    for text, holders in merged.items():
        # Contexts that overlap can be trimmed to one and the same place.
        _, *others = sorted(set(holders))
        removed += [(key, start, start + len(text)) for key, start in others]
    if len(merged) > 1:
        removed += sorted_runs([(text, *min(holders)) for text, holders in merged.items()], length)
    return removed


def sorted_runs(items: list[tuple], length: int = LENGTH) -> list[tuple]:
    """Of texts (text, key, start), the strings of the length that also start earlier, as (key, start, end)."""
    joined = b"".join([text for text, _, _ in items])
    sizes = np.array([len(text) for text, _, _ in items])
    ends = np.cumsum(sizes)
    order = np.array(suffix_array(np.frombuffer(joined, dtype=np.uint8).astype(np.int64) + 1))
    owner = np.searchsorted(ends, order, "right")
    whole = order + length <= ends[owner]  # the string lies in one text
    out: dict[int, list[int]] = {}

    def settle(run: list[tuple]) -> None:
        if len(run) > 1:
            first = min(run)
            for entry in run:
                if entry[:2] != first[:2]:
                    out.setdefault(entry[2], []).append(entry[1])

    run: list[tuple] = []
    last = b""
    for at, i in zip(order[whole].tolist(), owner[whole].tolist(), strict=True):
        window = joined[at : at + length]
        if window != last:
            settle(run)
            run, last = [], window
        text, key, start = items[i]
        run.append((key, start + at - int(ends[i]) + len(text), i))
    settle(run)
    return [(items[i][1], a, b) for i, starts in out.items() for a, b in spans(starts, length)]


def spans(starts: list[int], length: int) -> list[tuple[int, int]]:
    """The union of [start, start + length), as (start, end)."""
    out: list[list[int]] = []
    for s in sorted(starts):
        if out and s <= out[-1][1]:
            out[-1][1] = s + length
        else:
            out.append([s, s + length])
    return [(a, b) for a, b in out]


def _rank() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))


def _tie() -> Column:
    return F.xxhash64(text_of())


def _places(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """h, c (a hash of the context), rank, tie, place and end (of the context) of every anchor, and known: whether its text has the
    same context earlier. Those go for certain, so they get an h of their own and do not meet in one task."""
    names = ["h", "c", "rank", "tie", "place", "end", "known"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks, ties = batch.column("rank").to_numpy(), batch.column("tie").to_numpy()
            for text, place, h, c, end in text_anchors(_texts(batch), length, gram):
                if not len(h):
                    continue
                order = np.lexsort((place, c, h, text))
                again = np.ones(len(order), dtype=bool)
                again[0] = False
                for x in (text, h, c):
                    again[1:] &= x[order][1:] == x[order][:-1]
                known = np.zeros(len(order), dtype=bool)
                known[order[again]] = True
                rank, tie = ranks[text], ties[text]
                own = _mixed(_mixed(h.view(np.uint64) + place.astype(np.uint64) * np.uint64(_BASE)) + rank.view(np.uint64) + tie.view(np.uint64) * _MIX).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.where(known, own, h)), pa.array(c), pa.array(rank), pa.array(tie), pa.array(place, pa.int32()), pa.array(end, pa.int32()), pa.array(known)], names=names)

    return docs.mapInArrow(made, "h long, c long, rank long, tie long, place int, end int, known boolean")


def _grouped(rows: DataFrame) -> DataFrame:
    """The rows whose h stands in several places, with first: whether it is the earliest of its h and c. A row that is first comes only if its h has several c. Rows that are known come and are not first.

    Rows are dealt by h and pass in order of h, c and place, so a group is never held: a row or two are, to see what follows.
    """
    names = [f.name for f in rows.schema.fields if f.name not in ("c", "known")]
    marked = "known" in rows.columns

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[int] | None = None  # the key of the row before
        waiting: pa.RecordBatch | None = None  # the first row of the last h while that has one c

        def out(part: pa.RecordBatch, first: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(first)], names=[*names, "first"])

        for batch in batches:
            if not len(batch):
                continue
            # Which of the keys differ from those of the row before.
            changes = []
            for k, name in enumerate(("h", "c", "rank", "tie", "place")):
                x = batch.column(name).to_numpy()
                before = np.concatenate((x[:1] if last is None else np.array([last[k]], dtype=x.dtype), x[:-1]))
                changes.append(x != before)
            new_h = changes[0]
            new_h[0] |= last is None
            new_c = new_h | changes[1]
            # Equal rows of the input give a place more than once.
            fresh = new_c | changes[2] | changes[3] | changes[4]
            # Runs of one h; the first may go on from the batch before, the last may go on in the next.
            starts = np.flatnonzero(new_h)
            run = np.cumsum(new_h)  # 0: goes on
            kinds = np.bincount(run, weights=new_c, minlength=len(starts) + 1).astype(np.int64)
            open_before = not new_h[0]
            if open_before and kinds[0] and waiting is not None:
                yield out(waiting, np.array([True]))
            several = kinds > 1
            # A run that goes on already had a c, so any new one is a second.
            several[0] = open_before and kinds[0] > 0
            keep, first = fresh & (~new_c | several[run]), new_c
            if marked:
                known = batch.column("known").to_numpy(zero_copy_only=False)
                keep, first = keep | known, first & ~known
            if keep.any():
                yield out(batch.filter(pa.array(keep)), first[keep])
            if len(starts):
                waiting = None if several[-1] else batch.slice(int(starts[-1]), 1)
            elif kinds[0]:
                waiting = None
            last = [batch.column(n)[len(batch) - 1].as_py() for n in ("h", "c", "rank", "tie", "place")]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in names)
    return rows.repartition("h").sortWithinPartitions("h", "c", "rank", "tie", "place").mapInArrow(made, f"{fields}, first boolean")


_FOUND = "rank long, tie long, start long, end long"


def _found(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["rank", "tie", "start", "end"])


def _sorted_groups(rows: DataFrame, length: int) -> DataFrame:
    """Removed strings of rows (h, rank, tie, place, left, right) that hold the distinct contexts of anchors, as (rank, tie, start, end)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, out, known = None, [], [], set()

        def settle() -> None:
            out.extend((*key, a, b) for key, a, b in later(group, length))
            group.clear()

        for batch in batches:
            for h, rank, tie, place, left, right in zip(*(batch.column(c).to_pylist() for c in ("h", "rank", "tie", "place", "left", "right")), strict=True):
                if h != now:
                    settle()
                    now = h
                    known.clear()
                # Equal rows of the input give a context more than once.
                if (rank, tie, place) not in known:
                    known.add((rank, tie, place))
                    group.append(((rank, tie), place, left, right))
            if len(out) > 10_000:
                yield _found(out)
                out.clear()
        settle()
        yield _found(out)

    return rows.select("h", "rank", "tie", "place", "left", "right").repartition("h").sortWithinPartitions("h").mapInArrow(made, _FOUND)


def _refined(rows: DataFrame, length: int) -> DataFrame:
    """Contexts (h, rank, tie, place, left, right, on_left, on_right) whose anchor has on_left bytes of left and on_right of right, as those of longer anchors, with c."""
    parts = rows.selectExpr("*", f"{length} - on_left - on_right AS missing").selectExpr("*", "missing - missing div 2 AS to_right", "missing div 2 + 1 AS to_left")
    # A string with at least to_right bytes beyond the anchor on the right lies in the first, any other in the second.
    first = """struct(on_left AS on_left, on_right + to_right AS on_right, substring(right, 1, on_right + to_right) AS key, length(right) >= on_right + to_right AS enough,
        on_left + missing - to_right AS most_left, on_right + missing AS most_right)"""
    second = """struct(on_left + to_left AS on_left, on_right AS on_right, substring(left, length(left) - on_left - to_left + 1, on_left + to_left) AS key, length(left) >= on_left + to_left AS enough,
        on_left + missing AS most_left, on_right + missing - to_left AS most_right)"""
    each = parts.selectExpr("h", "rank", "tie", "place", "left", "right", f"posexplode(array({first}, {second})) AS (side, x)").where("x.enough")
    cut_off = each.selectExpr(
        "xxhash64(h, side, x.key) AS h", "rank", "tie", "place", "substring(left, greatest(length(left) - x.most_left, 0) + 1, x.most_left) AS left",
        "substring(right, 1, x.most_right) AS right", "x.on_left AS on_left", "x.on_right AS on_right",
    )
    return cut_off.where(F.length("left") + F.length("right") >= length).withColumn("c", F.xxhash64("left", "right", F.length("left")))


def removals(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, limit: int = LIMIT) -> DataFrame:
    """rank, tie (of a document: a hash of its text) and marks, its strings to remove as (start, end) in bytes, which may overlap."""
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    everything = docs.select(_rank().alias("rank"), _tie().alias("hash"), text_of().alias("text"))
    texts = scratch.keep("texts", everything.select("rank", "hash", F.unhex(F.md5(F.col("text").cast("binary"))).alias("d"), F.octet_length("text").alias("size")).distinct())
    # Only where texts share a rank are they told apart by their hash: else it is a constant, which takes no room in a shuffle.
    together = scratch.keep("together", texts.groupBy("rank").agg(F.count("*").alias("n")).where("n > 1").select("rank"))
    if together.isEmpty():
        tied = lambda df: df.withColumn("tie", F.lit(0).cast("long"))
    else:
        mark = small(together.withColumn("several", F.lit(True)))
        tied = lambda df: df.join(mark, "rank", "left").withColumn("tie", F.when(F.col("several"), F.col("hash")).otherwise(F.lit(0).cast("long"))).drop("several")
    everything, texts = tied(everything).drop("hash"), tied(texts)
    # Texts equal to that of an earlier document go whole; the rest of the work is on distinct texts.
    firsts = texts.groupBy("d").agg(F.min("rank").alias("first"), F.count("*").alias("n")).where("n > 1").select("d", "first")
    copies = scratch.keep("copies", texts.join(firsts, "d").where("rank > first").select("rank", "tie", "size"))
    copied = copies.where(F.col("size") >= length).select("rank", "tie", F.lit(0).alias("start"), F.col("size").alias("end"))
    rows = scratch.keep("rows", _grouped(_places(everything.join(small(copies.select("rank", "tie")), ["rank", "tie"], "left_anti").select("rank", "tie", "text"), length, gram)))
    reach = length - gram
    found = [copied, rows.where("not first").select("rank", "tie", F.greatest(F.col("place") - reach, F.lit(0)).alias("start"), "end").where(F.col("end") - F.col("start") >= length)]

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "rank", "tie", "place", "left", "right"]
        kinds = [*[pa.int64()] * 3, pa.int32(), *[pa.binary()] * 2]
        for batch in batches:
            for at in range(0, len(batch), 64):
                part, out = batch.slice(at, 64), []
                for text, rank, tie, open_ in zip(_texts(part), *(part.column(c).to_pylist() for c in ("rank", "tie", "open")), strict=True):
                    out += [(x["h"], rank, tie, x["place"], *context(text, x["place"], length, gram)) for x in open_]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], names=names)

    wanted = rows.where("first").groupBy("rank", "tie").agg(F.collect_list(F.struct("h", "place")).alias("open"))
    group = scratch.keep("contexts", everything.join(wanted, ["rank", "tie"]).select("rank", "tie", "text", "open").mapInArrow(bytes_of, "h long, rank long, tie long, place int, left binary, right binary"))
    group, level = group.selectExpr("*", "0 AS on_left", f"{gram} AS on_right"), 0
    while True:
        many = scratch.keep(f"many-{level}", group.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("h"))
        if many.isEmpty():
            found.append(_sorted_groups(group, length))
            break
        many = small(many)
        found.append(_sorted_groups(group.join(many, "h", "left_anti"), length))
        level += 1
        group = scratch.keep(f"refined-{level}", _grouped(_refined(group.join(many, "h", "left_semi"), length)))
        found.append(group.where("not first").selectExpr("rank", "tie", "place - length(left) AS start", "place + length(right) AS end"))
        group = group.where("first").drop("first")
    every = functools.reduce(DataFrame.union, [x.selectExpr("rank", "tie", "cast(start AS bigint) AS start", "cast(end AS bigint) AS end") for x in found])
    marks = every.groupBy("rank", "tie").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("marks"))
    marks = cut(marks.join(texts.select("rank", "tie", "hash"), ["rank", "tie"]).select("rank", F.col("hash").alias("tie"), "marks"))
    scratch.close()
    return marks


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, limit: int = LIMIT, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, doc_id, n_bytes, n_removed, n_spans, spans (array of start, end), kept (the remaining bytes) and kept_text (them
    without what is left of characters that were cut apart) of each document."""
    marks = removals(docs, length, gram, limit)
    columns = [c for c in dict.fromkeys((*keep, "doc_id")) if c != "text"]
    base = docs.select(*columns, _rank().alias("__rank"), _tie().alias("__tie"), text_of().alias("__text"))
    marks = marks.select(F.col("rank").alias("__rank"), F.col("tie").alias("__tie"), F.col("marks").alias("__marks"))
    both = base.join(marks, ["__rank", "__tie"], "left").select(*columns, F.col("__text").alias("text"), F.col("__marks").alias("marks"))
    kept_fields = [both.schema[c] for c in columns]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 256) for b in batches for at in range(0, max(len(b), 1), 256)):
            rows = []
            for text, marked in zip(_texts(batch), batch.column("marks").to_pylist(), strict=True):
                gone: list[list[int]] = []
                for m in marked or ():
                    if gone and m["start"] <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], m["end"])
                    else:
                        gone.append([m["start"], m["end"]])
                parts = [text[a:b] for a, b in zip([0, *(g[1] for g in gone)], [*(g[0] for g in gone), len(text)], strict=True)]
                rest = b"".join(parts)
                rows.append((len(text), len(text) - len(rest), len(gone), [{"start": a, "end": b} for a, b in gone], rest, "".join(part.decode("utf-8", "ignore") for part in parts)))
            kinds = [pa.int64()] * 3 + [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary(), pa.string()]
            new = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *new], names=[*columns, *names])

    names = ["n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_text"]
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([*kept_fields, *(T.StructField(n, T.LongType()) for n in names[:3]), T.StructField("spans", T.ArrayType(span)), T.StructField("kept", T.BinaryType()), T.StructField("kept_text", T.StringType())])
    return both.mapInArrow(made, schema)

"""Near-duplicate detection by Order MinHash.

A text is its words (runs of letters and digits, lower-cased). Its k-mers are the five-word shingles, each labelled with
its occurrence number, so that repeats count. For each of ``SKETCHES`` hash functions the ``TAKEN`` labelled shingles of
least hash are kept in the order of the text: two texts agree in a sketch with a probability that rises with the
shingles they share and falls where their order differs. Texts that agree in a sketch are candidates, and a pair is a
link if a banded alignment of the words shows an edit similarity (1 - edits / words of the longer) of ``SIMILARITY`` or
more. Classes are connected components of links.

Texts with the same words are one node, by partial aggregation, before anything else. Buckets (texts with one sketch)
with the same nodes are one bucket. First the node of each bucket that meets the most others in all its buckets, most
likely what the others were copied from, is compared with all the rest, and links make classes. Then the buckets that
still hold several classes are compared whole: in tiles of a bounded number of nodes and words, every two nodes of
different classes, the most alike first, unless the tile's own links have joined them or they share too few words for an edit
distance within the band; texts that meet in several buckets are compared in one. So any two texts of a bucket end in one class or were compared: classes are those of comparing every
pair of every bucket. No bucket is ever in one task, a tile gives the links that join its classes and never all pairs, and
rounds do not broadcast. Intermediate tables are written in the shared folder and deleted when they have served.

Defined results: a null text counts as empty; texts without words are one class. A text of fewer than five words is one
shingle. Rows with a null doc_id rank last in a class, by a hash of their text; a class of such rows alone has a null
class_id. Rows with one doc_id are nodes by their words; a doc_id with several texts has a row, and a class, for each.
A doc_id that is not a number is an error. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm._common import Scratch, cut, text_of

SHINGLE, SIMILARITY, SKETCHES, TAKEN = 5, 0.8, 20, 2
#: Nodes and words of one side of a tile, about; words of a tile that are sorted at once, about, and distinct ones multiplied at once.
TILE_NODES, TILE_WORDS, SLICE_WORDS, COLUMNS = 400, 4_000_000, 1_000_000, 4096
#: Words up to which texts are aligned by rows of bits.
BIT_WORDS = 8192
#: Words of texts that are sketched at once (a longer text is alone), and words whose hashes a worker keeps.
BATCH_WORDS, KEPT_WORDS = 200_000, 100_000

_WORDS = re.compile(r"[^\W_]+")
_PLACE = np.uint64((1 << 24) - 1)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MUL = np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MUL
    x ^= x >> np.uint64(32)
    x *= _MUL
    return x ^ (x >> np.uint64(32))


class WordHashes:
    """64-bit hashes of the words of texts; hashes of common words are kept."""

    def __init__(self) -> None:
        self.held: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = _WORDS.findall((text or "").lower())
        found = list(map(self.held.get, words))
        if None in found:
            if len(self.held) > KEPT_WORDS:
                self.held = {}
            for i, h in enumerate(found):
                if h is None:
                    found[i] = self.held[words[i]] = xxhash.xxh64_intdigest(words[i])
        return np.array(found, dtype=np.uint64)


def node_of(words: np.ndarray) -> int:
    """A signed 64-bit hash of the sequence of words."""
    return int(np.array([xxhash.xxh3_64_intdigest(words.tobytes())], dtype=np.uint64).view(np.int64)[0])


def sketches(texts: list[np.ndarray], count: int = SKETCHES) -> np.ndarray:
    """int64 of shape (texts, count); every text has at least one word."""
    sizes = np.array([len(t) for t in texts])
    words, starts = np.concatenate(texts), np.concatenate(([0], np.cumsum(sizes)[:-1]))
    n = len(words)
    # hashes[i]: of the words from i to i + 4, or as many as the text has.
    hashes = np.zeros(n, dtype=np.uint64)
    left = np.repeat(starts + sizes, sizes) - np.arange(n)
    for k in range(SHINGLE):
        shifted = np.zeros(n, dtype=np.uint64)
        shifted[: n - k] = words[k:]
        hashes = np.where(left > k, hashes * _ODD + shifted + np.uint64(k + 1), hashes)
    counts = np.maximum(sizes - SHINGLE + 1, 1)
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    doc = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(doc)) - first[doc]
    shingle = _mix(hashes[starts[doc] + place])
    # Occurrence numbers: places among equal shingles of one text, which a stable sort keeps in order.
    own = _mix(shingle + doc.astype(np.uint64) * _ODD)
    order = np.argsort(own, kind="stable")
    new = np.concatenate(([True], own[order][1:] != own[order][:-1]))
    rank = np.empty(len(doc), dtype=np.uint64)
    run = np.arange(len(doc))
    rank[order] = (run - np.maximum.accumulate(np.where(new, run, 0))).astype(np.uint64)
    labelled = _mix(shingle + rank * _MUL)
    low = place.astype(np.uint64) & _PLACE
    out = np.empty((len(texts), count), dtype=np.uint64)
    for i in range(count):
        value = (_mix(labelled + np.uint64((i + 1) * int(_ODD) % (1 << 64))) & ~_PLACE) | low
        taken = []
        for _ in range(TAKEN):
            least = np.minimum.reduceat(value, first)
            at = first + (least & _PLACE).astype(np.int64)
            there = least != _ALL
            taken.append(np.where(there, at, -1))
            value[at[there]] = _ALL
        places = np.sort(np.stack(taken), axis=0)  # in the order of the text; -1: the text has fewer
        sketch = np.zeros(len(texts), dtype=np.uint64)
        for row in places:
            sketch = np.where(row >= 0, _mix(sketch * _ODD + labelled[np.maximum(row, 0)]), sketch)
        out[:, i] = sketch
    return out.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether the edit similarity of two sequences of words is at least so much, by an alignment within the band that this allows."""
    longer = max(len(a), len(b))
    band = int((1 - least) * longer + 1e-9)
    if abs(len(a) - len(b)) > band:
        return False
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    if not len(differ):
        return True
    head = int(differ[0])
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if max(len(a), len(b)) <= band:
        return True
    # No alignment matches more words than the texts have in common.
    (va, ca), (vb, cb) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    shared, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    if max(len(a), len(b)) - np.minimum(ca[ia], cb[ib]).sum() > band:
        return False
    if _chained(a, b, a, b, shared[(ca[ia] == 1) & (cb[ib] == 1)], band) <= band:
        return True
    # Texts that repeat their words may still have runs of three once.
    ta, tb = (x[:-2] * _ODD + x[1:-1] * _MUL + x[2:] for x in (a.astype(np.uint64), b.astype(np.uint64)))
    (va, ca), (vb, cb) = np.unique(ta, return_counts=True), np.unique(tb, return_counts=True)
    shared, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    return _chained(a, b, ta, tb, shared[(ca[ia] == 1) & (cb[ib] == 1)], band) <= band or _aligned(a, b, band) <= band


def _chained(a: np.ndarray, b: np.ndarray, marks_a: np.ndarray, marks_b: np.ndarray, once: np.ndarray, band: int) -> int:
    """Edits of the alignment through the longest chain of marks (words, or runs that begin there) that each text has once: never fewer than the least."""
    at = np.flatnonzero(np.isin(marks_a, once))
    order = np.argsort(marks_b, kind="stable")
    to = order[np.searchsorted(marks_b, marks_a[at], sorter=order)]
    near = np.abs(at - to) <= band
    at, to = at[near], to[near].tolist()
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(to)
    for i, x in enumerate(to):
        k = bisect_left(tails, x)
        before[i] = ends[k - 1] if k else -1
        if k == len(tails):
            tails.append(x)
            ends.append(i)
        else:
            tails[k], ends[k] = x, i
    chain = []
    i = ends[-1] if ends else -1
    while i >= 0:
        chain.append((int(at[i]), to[i]))
        i = before[i]
    chain.reverse()
    edits, x, y, k = 0, 0, 0, 0
    while k < len(chain):
        # Words of the chain on one diagonal: between them, word by word.
        i, j = chain[k]
        while k + 1 < len(chain) and chain[k + 1][0] - chain[k + 1][1] == i - j:
            k += 1
        last = chain[k]
        edits += _gap(a, b, x, i, y, j) + int(np.count_nonzero(a[i : last[0]] != b[j : last[1]]))
        x, y, k = last[0] + 1, last[1] + 1, k + 1
        if edits > band:
            return edits
    return edits + _gap(a, b, x, len(a), y, len(b))


def _gap(a: np.ndarray, b: np.ndarray, x: int, x_end: int, y: int, y_end: int) -> int:
    """Edits of an alignment of a[x:x_end] and b[y:y_end] that keeps their common ends."""
    n = min(x_end - x, y_end - y)
    if not n:
        return max(x_end - x, y_end - y)
    head = a[x : x + n] != b[y : y + n]
    if x_end - x == y_end - y:
        return int(np.count_nonzero(head))
    differ = np.flatnonzero(head)
    lead = int(differ[0]) if len(differ) else n
    differ = np.flatnonzero(a[x_end - n : x_end][::-1] != b[y_end - n : y_end][::-1])
    trail = min(int(differ[0]) if len(differ) else n, n - lead)
    return max(x_end - x, y_end - y) - lead - trail


def _aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """The edit distance if it is at most band, else a number above it."""
    return _bitwise(a, b, band) if max(len(a), len(b)) <= BIT_WORDS else _banded(a, b, band)


def _bitwise(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """As _aligned(), by Myers' rows of bits: whether the distance rises or falls from one word of a to the next, for each word of b in turn."""
    if not len(a):
        return len(b)
    places: dict[int, int] = {}
    for i, word in enumerate(a.tolist()):
        places[word] = places.get(word, 0) | 1 << i
    every, last = (1 << len(a)) - 1, len(a) - 1
    up, down, edits = every, 0, len(a)
    for left, word in zip(range(len(b) - 1, -1, -1), b.tolist(), strict=True):
        same = places.get(word, 0)
        level = (((same & up) + up) ^ up) | same
        rise, fall = down | every & ~(level | up), up & level
        edits += (rise >> last) - (fall >> last)
        if edits - left > band:
            return edits - left
        rise, same = rise << 1 | 1, same | down
        up, down = (fall << 1 | ~(same | rise)) & every, rise & same & every
    return edits


def _banded(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """The edit distance if it is at most band, else a number above it: for each number of edits, how far each diagonal of the band gets."""
    n, m = len(a), len(b)
    # reach[band + 1 + k]: words of a that the diagonal k (place in b less place in a) has behind it.
    reach = np.full(2 * band + 3, -2, dtype=np.int64)
    for edits in range(band + 1):
        low, high = band + 1 - edits, band + 2 + edits
        k = np.arange(-edits, edits + 1)
        if edits:
            i = np.maximum(np.maximum(reach[low:high] + 1, reach[low - 1 : high - 1]), reach[low + 1 : high + 1] + 1)
            i = np.minimum(i, np.minimum(n, m - k))
        else:
            i = np.zeros(1, dtype=np.int64)
        going = np.flatnonzero((i >= 0) & (i + k >= 0) & (i < n) & (i + k < m))
        while len(going):
            going = going[a[i[going]] == b[i[going] + k[going]]]
            i[going] += 1
            going = going[(i[going] < n) & (i[going] + k[going] < m)]
        i[i + k < 0] = -2
        reach[low:high] = i
        if abs(m - n) <= edits and reach[band + 1 + m - n] >= n:
            return edits
    return band + 1


def _rank() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))


def signatures(docs: DataFrame, count: int = SKETCHES) -> DataFrame:
    """rank (doc_id, nulls last), tie (a hash of the text), node, n_words and sketches of each text."""
    names = ["rank", "tie", "node", "n_words", "sketches"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ids, texts, at = batch.select(["rank", "tie"]), batch.column("text"), 0
            while at < len(batch):
                words, size = [], 0
                while at + len(words) < len(batch) and size <= BATCH_WORDS:
                    words.append(hashes(texts[at + len(words)].as_py()))
                    size += len(words[-1])
                full = [w for w in words if len(w)]
                found = iter(sketches(full, count) if full else [])
                yield pa.RecordBatch.from_arrays([
                    *ids.slice(at, len(words)).columns, pa.array([node_of(w) for w in words], pa.int64()), pa.array([len(w) for w in words], pa.int64()),
                    pa.array([next(found) if len(w) else [] for w in words], pa.list_(pa.int64())),
                ], names=names)
                at += len(words)

    return docs.select(_rank().alias("rank"), F.xxhash64(text_of()).alias("tie"), "text").mapInArrow(made, "rank long, tie long, node long, n_words long, sketches array<long>")


def _word_table(docs: DataFrame) -> DataFrame:
    """node and its words' hashes, as bytes, of each text."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, len(batch), 256):
                words = [hashes(t.as_py()) for t in batch.column("text").slice(at, 256)]
                # 32 bits are enough to compare the words of two texts.
                yield pa.RecordBatch.from_arrays([pa.array([node_of(w) for w in words], pa.int64()), pa.array([w.astype(np.uint32).tobytes() for w in words], pa.binary())], names=["node", "words"])

    return docs.select("text").mapInArrow(made, "node long, words binary")


def verified(pairs: DataFrame, words: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose texts align."""
    left = words.select(F.col("node").alias("a"), F.col("words").alias("words_a"))
    right = words.select(F.col("node").alias("b"), F.col("words").alias("words_b"))

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = [[np.frombuffer(x.as_buffer(), dtype=np.uint32) for x in batch.column(c)] for c in ("words_a", "words_b")]
            keep = pa.array([similar(x, y, least) for x, y in zip(*seqs, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(keep)

    return pairs.hint("merge").join(right, "b").hint("merge").join(left, "a").select("a", "b", "words_a", "words_b").mapInArrow(aligned, "a long, b long")


def _shared(words: list[np.ndarray]) -> np.ndarray:
    """How many words each two texts have in common, repeats counted."""
    n = len(words)
    every, of_doc = np.concatenate(words), np.repeat(np.arange(n, dtype=np.int32), [len(w) for w in words])
    out = np.zeros((n, n), dtype=np.float32)
    slices = np.uint32(len(every) // SLICE_WORDS + 1)
    for s in range(slices):
        mine = every % slices == s
        doc, word = of_doc[mine], every[mine].astype(np.uint64)
        order = np.lexsort((word, doc))
        doc, word, run = doc[order], word[order], np.arange(len(word))
        # A word with its occurrence number is in a text or not, so what two texts share is a product of rows of ones.
        new = np.ones(len(word), dtype=bool)
        new[1:] = (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])
        labelled = word << np.uint64(32) | (run - np.maximum.accumulate(np.where(new, run, 0))).astype(np.uint64)
        _, place, held = np.unique(labelled, return_inverse=True, return_counts=True)
        column, keep = np.cumsum(held > 1) - 1, held[place] > 1
        doc, place = doc[keep], column[place[keep]]
        order = np.argsort(place, kind="stable")
        doc, place = doc[order], place[order]
        for low in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
            of = slice(*np.searchsorted(place, (low, low + COLUMNS)))
            ones = np.zeros((n, int(place[of][-1]) + 1 - low), dtype=np.float32)
            ones[doc[of], place[of] - low] = 1
            out += ones @ ones.T
    return out


def joining(words: list[np.ndarray], classes: np.ndarray, sides: np.ndarray, least: float = SIMILARITY, elsewhere: Sequence[frozenset] | None = None) -> list[tuple[int, int]]:
    """Of texts in classes, links (places) that join those classes which any links do. If there are two sides, only texts of different ones are
    compared. Two texts whose sets of elsewhere have a common element are compared there."""
    sizes, (_, root) = np.array([len(w) for w in words]), np.unique(classes, return_inverse=True)
    apart = np.triu(root[:, None] != root, 1)
    if sides.min() != sides.max():
        apart &= sides[:, None] != sides
    at, to = np.nonzero(apart)
    longer = np.maximum(sizes[at], sizes[to])
    band = np.floor((1 - least) * longer + 1e-9)
    near = np.abs(sizes[at] - sizes[to]) <= band
    at, to, longer, band = at[near], to[near], longer[near], band[near]
    if not len(at):
        return []
    # No alignment matches more words than the texts have in common.
    edits = longer - _shared(words)[at, to]
    near = edits <= band
    at, to, share = at[near], to[near], (edits / longer)[near]
    links = []
    # The most alike first: their links spare most other comparisons.
    order = np.argsort(share, kind="stable")
    for i, j in zip(at[order].tolist(), to[order].tolist(), strict=True):
        if root[i] != root[j] and (elsewhere is None or elsewhere[i].isdisjoint(elsewhere[j])) and similar(words[i], words[j], least):
            links.append((i, j))
            root[root == root[j]] = root[i]
    return links


def _tiled(now: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that join the classes of each bucket of now (key, node, n_words, label)."""
    open_ = now.groupBy("key").agg(F.count("*").alias("n"), F.sum("n_words").alias("size"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    parts = F.greatest(F.ceil(F.col("n") / TILE_NODES), F.ceil(F.col("size") / TILE_WORDS)).cast("int")
    mine = now.hint("merge").join(open_.select("key", parts.alias("parts")), "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # Texts that meet in several buckets are compared in the one of least key.
    texts = words.hint("merge").join(mine.groupBy("node").agg(F.collect_list("key").alias("keys")), "node")
    each = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = each.select("key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "node", "label")
    rows = placed.hint("merge").join(texts, "node").repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "node")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, []

        def settle() -> pa.RecordBatch:
            nodes, labels, sides, before, seqs = zip(*held, strict=True)
            found = joining([np.frombuffer(w, dtype=np.uint32) for w in seqs], np.array(labels), np.array(sides), least, before)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([f(nodes[i], nodes[j]) for i, j in found], pa.int64()) for f in (min, max)], names=["a", "b"])

        for batch in batches:
            for key, p, q, part, node, label, keys, seq in zip(*(batch.column(c).to_pylist() for c in ("key", "p", "q", "part", "node", "label", "keys", "words")), strict=True):
                if (key, p, q) != tile:
                    if held:
                        yield settle()
                    tile = key, p, q
                held.append((node, label, part, frozenset(k for k in keys if k < key), seq))
        if held:
            yield settle()

    return rows.select("key", "p", "q", "part", "node", "label", "keys", "words").mapInArrow(made, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """node and label, the least node of its component, of each node that has a link."""
    both = cut(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        seen = both.hint("merge").join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        lower = labels.hint("merge").join(seen, "node").select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        # A label is a node as well, so its own label is as good.
        hop = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = cut(lower.hint("merge").join(hop, "label", "left").select("node", "was", F.least("label", F.coalesce("further", "label")).alias("label")))
        labels = after.select("node", "label")
        if after.where("was <> label").isEmpty():
            return labels


def _no_longer(a: str, b: str, least: float) -> Column:
    """Whether two numbers of words are near enough for a link."""
    longer = F.greatest(a, b)
    return longer - F.least(a, b) <= F.floor((1 - least) * longer + 1e-9)


def _linked(members: DataFrame, words: DataFrame, least: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Links (a, b), and node and label, the same for all nodes of a class, of the nodes of members (key, node, n_words)."""
    sizes = members.groupBy("key").agg(F.count("*").alias("n"))
    labels = scratch.keep("merits", members.join(sizes, "key").groupBy("node").agg(F.sum("n").alias("merit")).select("node", F.col("node").alias("label"), "merit"))
    led = members.hint("merge").join(labels, "node")
    best = led.groupBy("key").agg(F.max(F.struct("merit", "node", "n_words")).alias("best")).select("key", F.col("best.node").alias("x"), F.col("best.n_words").alias("size"))
    led = scratch.keep("led", led.select("key", "node", "n_words").hint("merge").join(best, "key"))
    apart = (F.col("x") != F.col("node")) & _no_longer("n_words", "size", least)
    pairs = led.where(apart).select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()
    first = scratch.keep("first", verified(pairs, words, least))
    labels = scratch.keep("hooked", _hooked(labels, first))
    now = led.where("x <> node").select("key", "node", "n_words").hint("merge").join(labels, "node")
    links = scratch.keep("links", first.union(_tiled(now, words, least)).distinct())
    merged = components(_between(labels, links)).select(F.col("node").alias("label"), F.col("label").alias("into"))
    return links, labels.hint("merge").join(merged, "label", "left").select("node", F.coalesce("into", "label").alias("label"))


def _between(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The pairs (a, b) of labels that links join."""
    ends = [labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in "ab"]
    joined = links.hint("merge").join(ends[0], "a").hint("merge").join(ends[1], "b")
    return joined.where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()


def _hooked(labels: DataFrame, links: DataFrame) -> DataFrame:
    """node and label: of labels (node, label, merit), where every node is its own class, each has the label of the node of most merit
    that a link joins it with, if that has more than its own, and from there one step further. Nodes of one label are
    connected; the reverse is left to the end."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    merits = labels.select("node", "merit")
    best = both.hint("merge").join(merits.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.max(F.struct("merit", F.col("b").alias("node"))).alias("best"))
    # Ties of merit go to the greater node, so nothing hooks in a ring.
    up = best.hint("merge").join(merits, "node").where(F.col("best") > F.struct("merit", "node")).select("node", F.col("best.node").alias("up"))
    further = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
    into = up.hint("merge").join(further, "up", "left").select("node", F.coalesce("top", "up").alias("into"))
    return labels.hint("merge").join(into, "node", "left").select("node", F.coalesce("into", "label").alias("label"))


def classes(docs: DataFrame, least: float = SIMILARITY, count: int = SKETCHES) -> DataFrame:
    """doc_id, tie (a hash of its text), class_id (the least doc_id of its class), n_links (links of its words that make its class) and
    first (whether it is the one of its class that stays) of each document."""
    scratch = Scratch(docs.sparkSession, "near-dedup")
    signed = scratch.keep("signed", signatures(docs, count))
    nodes = scratch.keep("nodes", signed.where("n_words > 0").groupBy("node").agg(F.min(F.struct("rank", "tie")).alias("top"), F.first("sketches").alias("sketches"), F.first("n_words").alias("n_words")))
    keys = nodes.select("node", "n_words", F.posexplode("sketches").alias("i", "s")).select("node", "n_words", F.xxhash64("i", "s").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("h"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("g")).where("n > 1")
    shared = shared.groupBy("n", "h", "g").agg(F.min("key").alias("key")).select("key")
    members = scratch.keep("members", keys.join(shared, "key").select("key", "node", "n_words"))
    wanted = scratch.keep("wanted", members.select("node").distinct().join(nodes.select("node", "top"), "node").select("top.rank", "top.tie"))
    texts = docs.select(_rank().alias("rank"), F.xxhash64(text_of()).alias("tie"), "text").join(wanted.hint("merge"), ["rank", "tie"], "left_semi")
    words = scratch.keep("words", _word_table(texts).groupBy("node").agg(F.first("words").alias("words")))
    links, labels = _linked(members, words, least, scratch)
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    placed = nodes.select("node", "top").join(labels, "node", "left").join(ends, "node", "left").select("node", "top", F.coalesce("label", "node").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    named = placed.groupBy("label").agg(F.min("top").alias("class_top"))
    of_node = placed.join(named, "label").select("node", "class_top", "n_links")
    # Texts without words are one class.
    empty = signed.where("n_words = 0").agg(F.min(F.struct("rank", "tie")).alias("empty_top"))
    found = signed.select("rank", "tie", "node", "n_words").join(of_node, "node", "left").join(F.broadcast(empty), F.lit(True), "left")
    found = found.withColumn("top", F.when(F.col("n_words") == 0, F.col("empty_top")).otherwise(F.col("class_top")))
    named_id = lambda c: F.when(F.col(c) < (1 << 63) - 1, F.col(c))
    first = (F.col("rank") == F.col("top.rank")) & (F.col("tie") == F.col("top.tie"))
    result = cut(found.withColumn("top_rank", F.col("top.rank")).select(named_id("rank").alias("doc_id"), "tie", named_id("top_rank").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), first.alias("first")))
    scratch.close()
    return result

"""Token ids by the tokenizers library, with a bounded cache of the ids of space-delimited chunks.

Both public vocabularies split a text at white space before their merges run, so the ids of a text are
those of its chunks in order. A text is taken apart only where that holds for certain (printable ASCII and
Latin letters, single separators); any other text goes to the library whole. The ids are the library's.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of a generation of a cache, about 200 bytes each: four generations take 80 MB of a worker at most.
GENERATION = 100_000
#: Bytes of text encoded at once.
BATCH_BYTES = 4_000_000

#: Pieces that are encoded in one call.
PIECES = 2000

def _named_bytes() -> np.ndarray:
    """The character by which byte-level vocabularies write each byte: those that print as themselves, the others from 256 on. Byte 0 ends a piece: a space."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    named = np.zeros(256, dtype="<u4")
    named[shown] = shown
    named[[b for b in range(256) if b not in shown]] = np.arange(256, 512 - len(shown))
    named[0] = ord(" ")
    return named


_NAMED = _named_bytes()

# Printable ASCII and Latin letters, but for those with which libraries differ on classes or lower case.
_LATIN = " -~¡-±´-¸º»¿-įı-ſ"
_ODD_SPACED = f"[ \\n][ \\n]|^[ \\n]|[ \\n]$|[^\\n{_LATIN}]"
_ODD_WORDS = f"[^\\t\\n\\r{_LATIN}]"
#: Marks a text's first chunk, and a chunk that follows another without a space.
_START, _ON = "\x01", "\x02"
#: Texts where a full stop or comma is not a piece of its own.
_CLUSTERED = r"[.,][^\s\p{L}\p{N}]|[^\s\p{L}\p{N}][.,]|(?:^|\s)[.,]"
#: Pieces of a lower-cased chunk of those characters.
_SPACED_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def _word_pieces(chunk: str) -> list[str]:
    return _PIECES.findall(chunk)


def _spaced_pieces(chunk: str) -> list[str]:
    return _SPACED_PIECES.findall(chunk)


def _apart(texts: pa.Array, lead: str) -> pa.Array:
    """The texts with a lead before each full stop and comma, where those are pieces of their own: fewer distinct chunks."""
    spaced = pc.replace_substring(pc.replace_substring(texts, ".", lead + "."), ",", lead + ",")
    return pc.if_else(pc.match_substring_regex(texts, _CLUSTERED), texts, spaced)


def _word_lists(texts: pa.Array) -> pa.Array:
    return pc.ascii_split_whitespace(_apart(pc.utf8_lower(texts), " "))


class Cache:
    """ids by key. Keys that were asked for more than once at a time are held, the latest of them in two generations."""

    def __init__(self) -> None:
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def joined(self, keys: list[str], often: list[bool], make: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The ids of each of the distinct keys; make() gives those of the ones not held."""
        found = list(map(self.new.get, keys))
        gaps = [i for i, ids in enumerate(found) if ids is None]
        if self.old and gaps:
            for i, ids in zip(gaps, map(self.old.get, [keys[i] for i in gaps]), strict=True):
                if ids is not None:
                    found[i] = self.new[keys[i]] = ids
            gaps = [i for i in gaps if found[i] is None]
        if gaps:
            for i, ids in zip(gaps, make([keys[i] for i in gaps]), strict=True):
                found[i] = ids
            self.new.update({keys[i]: found[i] for i in gaps if often[i]})
        if len(self.new) > GENERATION:
            self.old, self.new = self.new, {}
        return found


class Encoder:
    """encode() gives the ids of each text of an array as little-endian unsigned 32-bit bytes; null has none.

    Strings of special tokens in a text are ordinary text (literal_specials) unless told otherwise.
    """

    def __init__(self, path: str, literal_specials: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread per task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = self.literal_specials = literal_specials
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        plain_bytes = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        steps = [x.get("type") for x in pre.get("pretokenizers", [])]
        drops_space = steps == ["Split", "ByteLevel"] and pre["pretokenizers"][0].get("behavior") == "Removed"
        if plain_bytes and not normal:
            self.odd, self.chunks, self.make = _ODD_SPACED, self._spaced_lists, self._encode_placed
            self._ready_for_spaced()
        elif drops_space and [x.get("type") for x in (normal or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and spec["model"].get("end_of_word_suffix"):
            self.odd, self.chunks, self.make = _ODD_WORDS, _word_lists, self._encode_chunks
            self._ready_for_words(spec)
        else:
            self.odd = None
        self.whole, self.pieces = Cache(), Cache()

    def _library(self, texts: list[str | None]) -> list[bytes]:
        found = self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Each distinct chunk of the texts is looked up once; ids are then gathered by place."""
        if self.odd is None:
            return self._library(texts.to_pylist())
        odd = pc.fill_null(pc.match_substring_regex(texts, self.odd), False)
        lists = self.chunks(pc.fill_null(pc.if_else(odd, "", texts), ""))
        coded = lists.flatten().dictionary_encode()
        often = (np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)) > 1).tolist()
        found = self.whole.joined(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), often, self.make)
        ends = np.zeros(len(found) + 1, dtype=np.int32)
        np.cumsum(np.fromiter(map(len, found), dtype=np.int32, count=len(found)) // 4, out=ends[1:])
        held = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), dtype="<u4")))
        taken = held.take(coded.indices)
        ends, all_ids = taken.offsets.to_numpy(), taken.values.to_numpy()
        at = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        out = [all_ids[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        aside = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        for i, blob in zip(aside.tolist(), self._library(texts.take(pa.array(aside)).to_pylist()), strict=True):
            out[i] = blob
        return out

    # Texts that lose their white space: chunks between white space, taken apart further where they are new.

    def _ready_for_words(self, spec: dict) -> None:
        self._ready_for_pieces(spec["model"].get("end_of_word_suffix"))

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        return self._from_pieces(chunks, chunks, _word_pieces)

    def _from_pieces(self, chunks: list[str], texts: list[str], cut: Callable[[str], list[str]]) -> list[bytes]:
        out: list[bytes] = [b""] * len(chunks)
        # Most new chunks are one word, which is one piece.
        alone, rest = [], []
        for i, c in enumerate(chunks):
            (alone if c.isalpha() else rest).append(i)
        for i, ids in zip(alone, self._encode_pieces([texts[i] for i in alone]), strict=True):
            out[i] = ids
        plain = [cut(texts[i]) if self.literal_specials or "<|" not in chunks[i] else None for i in rest]
        counts = Counter(chain.from_iterable(filter(None, plain)))
        distinct = list(counts)
        ids_of = dict(zip(distinct, self.pieces.joined(distinct, [n > 1 for n in counts.values()], self._encode_pieces), strict=True))
        for i, pieces in zip(rest, plain, strict=True):
            out[i] = self._library([texts[i]])[0] if pieces is None else b"".join([ids_of[p] for p in pieces])
        return out

    # Pieces are encoded many at a time, in the characters that the vocabulary has for their bytes; tokens tell by their lengths which piece they are of.

    def _ready_for_pieces(self, suffix: str | None = None) -> None:
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.bare_tokenizer = Tokenizer.from_str(self.tokenizer.to_str())
        self.bare_tokenizer.encode_special_tokens = True
        self.bare_tokenizer.normalizer = normalizers.Sequence([])
        self.bare_tokenizer.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.token_chars = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.token_chars[i] = len(token.removesuffix(suffix) if suffix else token)

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(pieces), PIECES):
            part = pieces[at : at + PIECES]
            raw = np.frombuffer("\0".join([*part, ""]).encode(), dtype=np.uint8)
            named = _NAMED[raw].tobytes().decode("utf-32-le")
            ids = np.array(self.bare_tokenizer.encode_batch_fast([named], add_special_tokens=False)[0].ids, dtype="<u4")
            # Characters of the pieces up to each token's, and each piece's, end.
            through = np.cumsum(self.token_chars[ids])
            wanted = np.flatnonzero(raw == 0) - np.arange(len(part))
            last = np.searchsorted(through, wanted)
            if last[-1] != len(ids) - 1 or (through[last] != wanted).any():
                raise ValueError("the vocabulary does not write pieces byte by byte")
            ends, blob = (4 * last + 4).tolist(), ids.tobytes()
            out += [blob[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return out

    # Texts whose pieces keep the space before them: a chunk at a line's start, and chunks led by a space.

    def _ready_for_spaced(self) -> None:
        self._ready_for_pieces()
        self.newline = self._library(["\n"])[0]

    def _encode_spaced_chunks(self, chunks: list[str], lead: str) -> list[bytes]:
        return self._from_pieces(chunks, [lead + c for c in chunks], _spaced_pieces)

    def _spaced_lists(self, texts: pa.Array) -> pa.Array:
        return pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(_START, _apart(texts, f" {_ON}"), ""), "\n", " \n"), " ")

    def _encode_placed(self, chunks: list[str]) -> list[bytes]:
        """Chunks as lists have them: a line's first begins with the line break, others without a space before them with a mark."""
        bare = "\n" + _START + _ON
        heads = [i for i, c in enumerate(chunks) if c[0] in bare]
        led = [i for i, c in enumerate(chunks) if c[0] not in bare]
        out: list[bytes] = [b""] * len(chunks)
        for i, ids in zip(heads, self._encode_spaced_chunks([chunks[i][1:] for i in heads], ""), strict=True):
            out[i] = self.newline + ids if chunks[i][0] == "\n" else ids
        for i, ids in zip(led, self._encode_spaced_chunks([chunks[i] for i in led], " "), strict=True):
            out[i] = ids
        return out

    def stream(self, texts: pa.Array) -> Iterator[tuple[int, bytes]]:
        """(place, ids) of each text; at most about BATCH_BYTES, or one longer text, are in work at once."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
        at = 0
        while at < len(texts):
            end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), BATCH_BYTES, "right")))
            yield from enumerate(self.encode(texts.slice(at, end - at)), at)
            at = end


@functools.cache
def encoder(path: str) -> Encoder:
    """One per worker process, so that its cache serves every task the worker runs."""
    return Encoder(path)

"""Normalisation, grams and similarity as built-in column expressions: no Python runs on the executors."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F


class Fold(Enum):
    NONE = "none"
    LATIN = "latin"


#: Unicode White_Space, which neither trim() nor \s covers.
WHITE_SPACE = "[\\t-\\r \u0085   -     　]+"
#: Pads grams: a noncharacter, so no text holds it.
PAD = "￿"

# Letters of Latin-1 and Latin Extended-A that Unicode does not decompose into an ASCII letter and marks,
# and those that become two letters.
PLAIN = {"ð": "d", "ø": "o", "đ": "d", "ħ": "h", "ı": "i", "ĸ": "k", "ŀ": "l", "ł": "l", "ŋ": "n", "ŉ": "n", "ŧ": "t", "ſ": "s"}
DOUBLE = {"æ": "ae", "þ": "th", "ß": "ss", "ĳ": "ij", "œ": "oe"}


def _single() -> dict[str, str]:
    """Every lower-case letter from U+00E0 to U+017F that folds to one ASCII letter: its decomposition's first, or a fixed value."""
    found = dict(PLAIN)
    for code in range(0xE0, 0x180):
        letter = chr(code)
        parts = unicodedata.normalize("NFD", letter)
        if letter == letter.lower() and len(parts) > 1 and parts[0].isascii() and parts[0].isalpha():
            found.setdefault(letter, parts[0])
    return found


SINGLE = _single()


def folded(text: Column) -> Column:
    """Latin letters without their marks; all else as it is."""
    out = F.translate(text, "".join(SINGLE), "".join(SINGLE.values()))
    for letter, pair in DOUBLE.items():
        out = F.replace(out, F.lit(letter), F.lit(pair))
    return out


def normalize(text: Column, fold: Fold = Fold.LATIN) -> Column:
    """Lower case first, then runs of white space as one space and none at the ends, then the fold."""
    out = F.trim(F.regexp_replace(F.lower(text), WHITE_SPACE, " "))
    return folded(out) if fold is Fold.LATIN else out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once a row however often body names it: the optimizer copies an alias's expression to
    wherever it is named, into the body of a transform too, but not a lambda's argument."""
    return F.transform(F.array(value), body)[0]


def grams(normal: Column, n: int = 3) -> Column:
    """Distinct windows of n code points over a normalised text padded with n - 1 pads at both ends; an empty text has the one of pads alone, and none if n is 1."""
    pads = F.lit(PAD * (n - 1))

    def windows(letters: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(letters) - n), lambda i: F.concat(*[F.get(letters, i + j) for j in range(n)])))

    blank = F.array(F.lit(PAD * n)) if n > 1 else F.array().cast("array<string>")
    return let(normal, lambda t: F.when(F.length(t) == 0, blank).otherwise(let(F.split(F.concat(pads, t, pads), ""), windows)))


def key_length(normal: Column) -> Column:
    """Code points, as the one byte that a posting holds."""
    return F.least(F.length(normal), F.lit(255))


def length_gap(a: Column, b: Column) -> Column:
    return F.abs(key_length(a) - key_length(b))


def edit_distance(a: Column, b: Column, most: int) -> Column:
    """Edits between code points if at most so many, else null."""
    d = F.levenshtein(a, b, most)
    return F.when(d >= 0, d)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(query: Column, record: Column) -> Column:
    """Shared over the query's elements; 1 for an empty query."""
    total = F.size(query)
    return F.when(total == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(query, record)) / total)

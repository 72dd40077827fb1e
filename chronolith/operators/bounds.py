"""Bounds of an index lookup, as predicates that reach the Parquet scan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class All:
    def predicate(self, fields: tuple[str, ...]) -> Column:
        return F.lit(True)


@dataclass(frozen=True)
class Exact:
    values: tuple

    def predicate(self, fields: tuple[str, ...]) -> Column:
        if len(self.values) != len(fields):
            raise ValueError("an exact bound has a value for each field")
        return _all(F.col(f) == F.lit(v) for f, v in zip(fields, self.values, strict=True))


@dataclass(frozen=True)
class Range:
    """Half-open: from low on, below high. Composite keys compare field by field."""

    low: tuple
    high: tuple

    def predicate(self, fields: tuple[str, ...]) -> Column:
        return ~_below(fields, self.low) & _below(fields, self.high)


@dataclass(frozen=True)
class Prefix:
    """A string's beginning, the leading fields of a composite key (then the last value may be a beginning), or an integer's high bytes."""

    values: tuple
    bits: int | None = None

    def predicate(self, fields: tuple[str, ...]) -> Column:
        *leading, last = self.values
        found = [F.col(f) == F.lit(v) for f, v in zip(fields, leading, strict=False)]
        field = F.col(fields[len(leading)])
        if self.bits is not None:
            # High bytes of an unsigned number of so many bits span one block of values.
            low = int.from_bytes(last, "big") << (self.bits - 8 * len(last))
            found.append((field >= low) & (field < low + (1 << (self.bits - 8 * len(last)))))
        elif isinstance(last, str):
            found.append(field.startswith(last))
        else:
            found.append(field == F.lit(last))
        return _all(found)


def _all(parts) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def _below(fields: tuple[str, ...], values: tuple) -> Column:
    """Whether the fields' tuple is less than the values'."""
    out = F.lit(False)
    for f, v in reversed(list(zip(fields, values, strict=True))):
        out = (F.col(f) < F.lit(v)) | ((F.col(f) == F.lit(v)) & out)
    return out

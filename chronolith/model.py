"""Declarations of record types.

A type is fixed and nominal: any change of its name, shape, fields or indexes gives another ``struct_hash`` and so
another table. Keys of indexes and lists order like their columns, so floating-point columns cannot be keys.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolith.errors import InvalidDeclaration
from chronolith.functions import Fold
from chronolith.functions.ids import FLAG_BITS, SALT_BITS

U48 = 1 << 48
KEY_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.BooleanType, T.StringType, T.BinaryType, T.StructType)


@dataclass(frozen=True)
class Id:
    """A 128-bit address: 64 bits of key, 48 of tenant, one that says that the key is a type's hash, 15 of salt."""

    raw: int

    @classmethod
    def of(cls, key: int, tenant: int, flag: bool = False, salt: int = 0) -> Id:
        if not 0 <= key < 1 << 64 or not 0 <= tenant < U48:
            raise InvalidDeclaration("a key has 64 bits, a tenant 48")
        low = (tenant << FLAG_BITS + SALT_BITS) | (int(flag) << SALT_BITS) | (salt & (1 << SALT_BITS) - 1)
        return cls(key << 64 | low)

    @property
    def key(self) -> int:
        return self.raw >> 64

    @property
    def tenant(self) -> int:
        return self.raw >> FLAG_BITS + SALT_BITS & U48 - 1

    @property
    def is_unique_anchor(self) -> bool:
        return bool(self.raw >> SALT_BITS & 1)

    @property
    def salt(self) -> int:
        return self.raw & (1 << SALT_BITS) - 1

    @property
    def created_at(self) -> int | None:
        return None if self.is_unique_anchor else self.key

    @property
    def struct_hash(self) -> int | None:
        return self.key if self.is_unique_anchor else None


class Shape(Enum):
    UNIQUE = "unique"
    NON_UNIQUE = "non_unique"


@dataclass(frozen=True)
class FuzzyIndex:
    """An n-gram index over one string field."""

    field: str
    n: int = 3
    fold: Fold = Fold.LATIN


@dataclass(frozen=True)
class RecordType:
    """name, shape and body; key: natural key fields; pivots, lists: tuples of key fields; fuzzy: text indexes."""

    name: str
    shape: Shape
    body: T.StructType
    key: tuple[str, ...] = ()
    pivots: tuple[tuple[str, ...], ...] = ()
    lists: tuple[tuple[str, ...], ...] = ()
    fuzzy: tuple[FuzzyIndex, ...] = ()
    page: int = 16
    compress: bool = True
    struct_hash: int = field(init=False)

    def __post_init__(self) -> None:
        if self.shape is Shape.UNIQUE and (self.key or self.pivots or self.lists or self.fuzzy):
            raise InvalidDeclaration(f"{self.name}: a unique type has one record per tenant, so it has no key and no index")
        names = self.body.fieldNames()
        for group in (self.key, *self.pivots, *self.lists):
            for f in group:
                if f not in names or not isinstance(self.body[f].dataType, KEY_TYPES):
                    raise InvalidDeclaration(f"{self.name}: {f} cannot be a key")
        for index in self.fuzzy:
            if index.field not in names or not isinstance(self.body[index.field].dataType, T.StringType):
                raise InvalidDeclaration(f"{self.name}: {index.field} is not a string field")
        text = "|".join([self.name, self.shape.value, self.body.simpleString(), repr(self.key), repr(self.pivots), repr(self.lists), repr([(x.field, x.n, x.fold.value) for x in self.fuzzy]), str(self.page), str(self.compress)])
        object.__setattr__(self, "struct_hash", int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big") >> 1)

    def natural_key(self, values: dict) -> tuple | None:
        """The address of a keyed value: its key fields. No hash is needed."""
        return tuple(values[f] for f in self.key) if self.key else None

    def key_columns(self) -> list[Column]:
        return [F.col(f) for f in self.key]

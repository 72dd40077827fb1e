"""What a store refuses."""


class StoreError(Exception):
    """Base of all refusals."""


class RecordMissing(StoreError):
    """No record at this address."""


class PivotMissing(StoreError):
    """No collection under this handle."""


class KeyMismatch(StoreError):
    """The value's natural key is not that of the record it is saved to."""


class Conflict(StoreError):
    """An expectation on the state before the batch does not hold; nothing was written."""


class SecondaryIndexOutOfRange(StoreError):
    """The type declares no such index."""


class ListOutOfRange(StoreError):
    """The type declares no such list."""


class FuzzyOutOfRange(StoreError):
    """The type declares no such fuzzy index."""


class UnknownStructHash(StoreError):
    """The registry exposes no type or function of this hash."""


class NotExposed(StoreError):
    """The type is registered, but not this operation."""


class LoginRequired(StoreError):
    """An anonymous session called what is not public."""


class CollisionError(StoreError):
    """Two registered declarations share a hash."""


class InvalidDeclaration(StoreError):
    """A type's declaration does not hold together."""


class InvalidRecord(StoreError):
    """A value does not fit its type."""

"""What a deployment offers: an explicit allowlist of types, their operations and server functions.

Whatever is not registered does not exist for callers. Functions run next to the data: f(context, **args) returns a value,
a DataFrame, or a generator for streamed results.
"""

from __future__ import annotations

import functools
import hashlib
import inspect
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.functions import PandasUDFType, pandas_udf

from chronolith.errors import CollisionError, LoginRequired, NotExposed, UnknownStructHash
from chronolith.model import RecordType
from chronolith.operators.collection import Session

OPERATIONS = ("get", "save", "insert", "update", "remove", "all", "history", "changes", "listed", "list_len")


@dataclass(frozen=True)
class Context:
    """What a server function gets: the caller's session and Spark. as_tenant() re-scopes it, which callers cannot."""

    spark: Any
    session: Session

    def as_tenant(self, tenant: int) -> Context:
        return Context(self.spark, self.session.as_tenant(tenant))


@dataclass(frozen=True)
class ServerFunction:
    name: str
    body: Callable
    public: bool = False

    @property
    def struct_hash(self) -> int:
        text = f"fn {self.name}{inspect.signature(self.body)}"
        return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big") >> 1


class Registry:
    def __init__(self) -> None:
        self._types: dict[int, tuple[RecordType, dict[str, Callable | None]]] = {}
        self._functions: dict[int, ServerFunction] = {}
        self._names: dict[str, int] = {}
        self._aggregates: dict[str, Callable] = {}

    def _claim(self, struct_hash: int, name: str) -> None:
        if struct_hash in self._types or struct_hash in self._functions or name in self._names:
            raise CollisionError(name)
        self._names[name] = struct_hash

    def expose_type(self, kind: RecordType, operations: tuple[str, ...] = OPERATIONS, overrides: dict[str, Callable] | None = None) -> None:
        """Offers a type's operations; an override replaces one; what is not listed is refused."""
        unknown = (set(operations) | set(overrides or ())) - set(OPERATIONS)
        if unknown:
            raise NotExposed(f"no such operations: {sorted(unknown)}")
        self._claim(kind.struct_hash, kind.name)
        self._types[kind.struct_hash] = (kind, {o: None for o in operations} | (overrides or {}))

    def expose_function(self, body: Callable, name: str | None = None, public: bool = False) -> ServerFunction:
        made = ServerFunction(name or body.__name__, body, public)
        self._claim(made.struct_hash, made.name)
        self._functions[made.struct_hash] = made
        return made

    def knows(self, struct_hash: int) -> bool:
        return struct_hash in self._types or struct_hash in self._functions

    def call(self, name: str, context: Context, /, *args, **named):
        """Runs a server function. Only public ones run for anonymous sessions."""
        found = self._functions.get(self._names.get(name, -1))
        if found is None:
            raise UnknownStructHash(name)
        if context.session.anonymous and not found.public:
            raise LoginRequired(name)
        return found.body(context, *args, **named)

    def table(self, name: str, context: Context, /, *args, **named) -> DataFrame:
        """The frames that a streaming function yields, as one table."""
        return functools.reduce(DataFrame.unionByName, self.stream(name, context, *args, **named))

    def stream(self, name: str, context: Context, /, *args, **named) -> Iterator[DataFrame]:
        """The frames that a function yields, one after the other; a function that returns one yields that."""
        found = self.call(name, context, *args, **named)
        yield from (found,) if isinstance(found, DataFrame) else found

    def expose_aggregate(self, name: str, body: Callable, returns: str) -> None:
        """Offers an aggregate function: body(column as a pandas Series) gives one value for each group."""
        made = ServerFunction(f"aggregate {name}", body, public=True)
        self._claim(made.struct_hash, made.name)
        self._aggregates[name] = pandas_udf(lambda column: body(column), returns, PandasUDFType.GROUPED_AGG)

    def aggregate(self, name: str) -> Callable:
        if name not in self._aggregates:
            raise UnknownStructHash(name)
        return self._aggregates[name]

    def perform(self, struct_hash: int, operation: str, handle, /, *args, **values):
        """An operation on a handle, by way of its override if there is one."""
        if struct_hash not in self._types:
            raise UnknownStructHash(str(struct_hash))
        kind, operations = self._types[struct_hash]
        if operation not in operations:
            raise NotExposed(f"{kind.name}.{operation}")
        if handle.session.anonymous:
            raise LoginRequired(f"{kind.name}.{operation}")
        override = operations[operation]
        if override is not None:
            return override(handle, *args, **values)
        return getattr(handle, {"update": "save"}.get(operation, operation))(*args, **values)

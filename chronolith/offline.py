"""Working without the store: a queue of unique saves, and a local mirror for reads."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame

from chronolith.errors import StoreError


class OfflineQueue:
    """Saves of unique records that wait for the store, first in first out. A refusal drops the save; a fault of transport stops the replay."""

    def __init__(self) -> None:
        self.waiting: deque[Callable[[], object]] = deque()
        self.refused: list[StoreError] = []

    def save(self, record, **values) -> int | None:
        """Saves now if nothing waits and the store is there; else queues, and returns None."""
        if not self.waiting:
            try:
                return record.save(**values)
            except (ConnectionError, TimeoutError):
                pass
        self.waiting.append(lambda: record.save(**values))
        return None

    def replay(self) -> int:
        """How many queued saves came through."""
        done = 0
        while self.waiting:
            try:
                self.waiting[0]()
                done += 1
            except StoreError as e:
                self.refused.append(e)
            except (ConnectionError, TimeoutError):
                break
            self.waiting.popleft()
        return done


class Mirror:
    """The last result of each read, served when the store cannot be reached and only if it was read before."""

    def __init__(self) -> None:
        self.held: dict[str, DataFrame] = {}

    def read(self, name: str, now: Callable[[], DataFrame]) -> DataFrame:
        try:
            found = now().cache()
            found.count()
        except (ConnectionError, TimeoutError):
            if name not in self.held:
                raise
            return self.held[name]
        if name in self.held:
            self.held[name].unpersist()
        self.held[name] = found
        return found

"""Where logs are kept: Parquet folders with an atomic manifest per commit, or the driver's memory."""

from chronolith.sources.memory import MemoryStore
from chronolith.sources.store import Commit, Expect, LogStore

__all__ = ["Commit", "Expect", "LogStore", "MemoryStore"]

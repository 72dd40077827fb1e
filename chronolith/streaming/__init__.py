"""Live watches over logs with Structured Streaming."""

from chronolith.streaming.watch import Watch, poll, watch_collection, watch_unique

__all__ = ["Watch", "poll", "watch_collection", "watch_unique"]

"""Readers by platform and type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tidewire.sources import feeds, messages

Reader = Callable[..., DataFrame]
_readers: dict[tuple[str, str | None], Reader] = {}


def register(platform: str, kind: str | None, reader: Reader) -> None:
    _readers[platform, kind] = reader


def reader(platform: str, kind: str | None = None) -> Reader:
    """The reader of a platform's type, else of the platform."""
    found = _readers.get((platform, kind)) or _readers.get((platform, None))
    if found is None:
        raise KeyError(f"no reader for {platform} {kind or ''}".strip())
    return found


register("rss", None, feeds.rss_items)
register("rss", "atom", feeds.atom_entries)
register("telegram", None, messages.read_messages)
register("twitter", None, messages.read_posts)

"""Driver-side cache of plans and small results, keyed by arguments and data version."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Hashable
from functools import wraps
from typing import Any


class LRUCache:
    """Keeps the most recently used entries; counts hits and misses."""

    def __init__(self, maxsize: int = 128) -> None:
        self.maxsize, self.hits, self.misses = maxsize, 0, 0
        self._entries: OrderedDict[Hashable, Any] = OrderedDict()

    def get(self, key: Hashable, default: Any = None) -> Any:
        if key in self._entries:
            self.hits += 1
            self._entries.move_to_end(key)
            return self._entries[key]
        self.misses += 1
        return default

    def put(self, key: Hashable, value: Any) -> None:
        self._entries[key] = value
        self._entries.move_to_end(key)
        while len(self._entries) > self.maxsize:
            self._entries.popitem(last=False)

    def clear(self) -> None:
        self._entries.clear()
        self.hits = self.misses = 0

    def stats(self) -> dict[str, float]:
        asked = self.hits + self.misses
        return {"size": len(self._entries), "maxsize": self.maxsize, "hits": self.hits, "misses": self.misses, "hit_rate": self.hits / asked if asked else 0.0}


class Version:
    """A number that moves on when the data change; part of every key, so old entries are never found again."""

    def __init__(self) -> None:
        self.number = 0

    def invalidate(self) -> int:
        self.number += 1
        return self.number


def cached(cache: LRUCache, key: Callable[..., Hashable] | None = None, version: Version | None = None):
    """Decorator: results are kept by key and version; None is never kept."""

    def wrap(run: Callable) -> Callable:
        @wraps(run)
        def call(*args: Any, **kwargs: Any) -> Any:
            own = key(*args, **kwargs) if key else (args, tuple(sorted(kwargs.items())))
            whole = (run.__qualname__, own, version.number if version else 0)
            found = cache.get(whole)
            if found is None:
                found = run(*args, **kwargs)
                if found is not None:
                    cache.put(whole, found)
            return found

        return call

    return wrap

"""A least-recently-used cache whose entries expire; values are copied in and out."""

from __future__ import annotations

import copy
import hashlib
import threading
import time
from collections import OrderedDict
from collections.abc import Callable
from typing import Any


class Cache:
    def __init__(self, entries: int = 100, seconds: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self._entries, self._seconds, self._clock = entries, seconds, clock
        self._held: OrderedDict[str, tuple[float, Any]] = OrderedDict()
        self._lock = threading.Lock()
        self.hits = self.misses = 0

    def get(self, key: str) -> Any | None:
        with self._lock:
            at, value = self._held.get(key, (None, None))
            if at is None or self._clock() - at > self._seconds:
                self._held.pop(key, None)
                self.misses += 1
                return None
            self._held.move_to_end(key)
            self.hits += 1
            return copy.deepcopy(value)

    def put(self, key: str, value: Any) -> None:
        with self._lock:
            self._held[key] = (self._clock(), copy.deepcopy(value))
            self._held.move_to_end(key)
            while len(self._held) > self._entries:
                self._held.popitem(last=False)

    def expire(self) -> int:
        """Drop what is too old; how many entries went."""
        with self._lock:
            old = [k for k, (at, _) in self._held.items() if self._clock() - at > self._seconds]
            for k in old:
                del self._held[k]
            return len(old)

    def clear(self) -> None:
        with self._lock:
            self._held.clear()

    def __len__(self) -> int:
        return len(self._held)

    @property
    def hit_rate(self) -> float:
        asked = self.hits + self.misses
        return self.hits / asked if asked else 0.0


def key(query: str, project: str | None, kind: str, limit: int, *more: Any) -> str:
    """The same key as ``functions.text.cache_key``; every filter and the table's version take part."""
    parts = [query.strip().lower(), project or "", kind, str(limit), *["" if m is None else str(m) for m in more]]
    return hashlib.sha256("|".join(parts).encode("utf-8", "replace")).hexdigest()[:32]

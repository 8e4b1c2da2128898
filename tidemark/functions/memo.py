"""Frames that are kept for a while: computed once, given again until they are too old."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame


class Memo:
    """Keeps persisted frames by name for `ttl` seconds; an old one is released and made anew."""

    def __init__(self, ttl: float = 3600.0, clock: Callable[[], float] = time.monotonic):
        self.ttl, self.clock = ttl, clock
        self.held: dict[str, tuple[float, DataFrame]] = {}

    def get(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        at, frame = self.held.get(name, (0.0, None))
        if frame is None or self.clock() - at >= self.ttl:
            if frame is not None:
                frame.unpersist()
            frame = make().persist(StorageLevel.MEMORY_AND_DISK)
            self.held[name] = (self.clock(), frame)
        return frame

    def clear(self) -> None:
        for _, frame in self.held.values():
            frame.unpersist()
        self.held.clear()

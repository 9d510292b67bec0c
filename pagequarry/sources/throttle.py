"""Pauses between runs of one source, for sources that fetch."""

from __future__ import annotations

import math
import random
import time
from collections.abc import Callable

JITTER_MS = 100


class Slots:
    """Start times of a source's runs on one of several workers: each owns every so many-th slot of the clock.

    Slots are base_ms and JITTER_MS apart, counted from the epoch, and a slot is one worker's alone, so
    runs on different workers are never nearer than base_ms less the jitter and what their clocks
    differ; no worker asks another. A run that takes longer gives up the slots that pass.
    """

    def __init__(self, base_ms: int, worker: int, workers: int, sleep: Callable[[float], None] = time.sleep, now: Callable[[], float] = time.time):
        self.step, self.worker, self.workers, self.sleep, self.now = (base_ms + JITTER_MS) / 1000, worker, workers, sleep, now
        self.base_ms, self._last = base_ms, {}

    def take(self, alias: str) -> float:
        """The start of the next slot."""
        cycle, offset = self.step * self.workers, self.step * self.worker
        at = max(self._last.get(alias, -1) + 1, math.ceil((self.now() - offset) / cycle))
        self._last[alias] = at
        return at * cycle + offset

    def run(self, alias: str, f: Callable, *args):
        if self.base_ms:
            start = self.take(alias) + random.uniform(0, JITTER_MS / 1000)
            if (wait := start - self.now()) > 0:
                self.sleep(wait)
        return f(*args)

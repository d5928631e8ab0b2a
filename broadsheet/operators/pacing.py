"""Pacing and retries of outside calls, with clocks that tests can replace."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from typing import TypeVar

R = TypeVar("R")


class TokenBucket:
    """At most ``capacity`` calls at once and ``rate`` a second over time."""

    def __init__(self, rate: float, capacity: float = 1.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        if rate <= 0 or capacity < 1:
            raise ValueError("rate must be positive and capacity at least 1")
        self.rate, self.capacity, self.clock, self.sleep = rate, capacity, clock, sleep
        self.level, self.at = capacity, clock()

    def acquire(self) -> float:
        """Seconds waited."""
        now = self.clock()
        self.level = min(self.capacity, self.level + (now - self.at) * self.rate)
        self.at = now
        wait = 0.0 if self.level >= 1 else (1 - self.level) / self.rate
        if wait:
            self.sleep(wait)
            self.level, self.at = 1.0, now + wait
        self.level -= 1
        return wait


class DomainDelay:
    """A random pause before a domain is asked again; other domains don't wait."""

    def __init__(self, least: float, most: float, draw: Callable[[float, float], float] = random.uniform, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.least, self.most, self.draw, self.clock, self.sleep = least, max(least, most), draw, clock, sleep
        self.last: dict[str, float] = {}

    def wait(self, domain: str) -> float:
        pause = 0.0
        if domain in self.last:
            pause = max(0.0, self.last[domain] + self.draw(self.least, self.most) - self.clock())
            if pause:
                self.sleep(pause)
        self.last[domain] = self.clock()
        return pause


def with_retries(call: Callable[[], R], retries: int, transient: Callable[[Exception], bool], sleep: Callable[[float], None] = time.sleep, longest: float = 30.0) -> R:
    """Result of a call, retried after transient failures with doubling pauses."""
    for attempt in range(retries + 1):
        try:
            return call()
        except Exception as e:  # noqa: BLE001
            if attempt == retries or not transient(e):
                raise
            sleep(min(2.0**attempt, longest))
    raise AssertionError("unreachable")

"""Repeating a refresh: Fibonacci waits, transient and permanent failures, jitter."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from datetime import timedelta
from typing import TypeVar

R = TypeVar("R")


class Permanent(Exception):
    """A failure that repeating won't mend."""


def waits(most: int | None = None, longest: float = 300.0) -> Iterator[float]:
    """Seconds 1, 1, 2, 3, 5, … up to ``longest``, ``most`` times."""
    a, b, n = 1.0, 1.0, 0
    while most is None or n < most:
        yield min(a, longest)
        a, b, n = b, a + b, n + 1


def with_retry(action: Callable[[], R], most: int = 3, sleep: Callable[[float], None] = time.sleep, permanent: tuple[type[Exception], ...] = (Permanent,)) -> R:
    """The action's result; transient failures are retried ``most`` times, permanent ones raised at once."""
    for wait in waits(most):
        try:
            return action()
        except permanent:
            raise
        except Exception:
            sleep(wait)
    return action()


def jittered(period: timedelta, most: timedelta, rng: random.Random | None = None) -> timedelta:
    """The period plus or minus up to ``most``, never below zero."""
    off = (rng or random.Random()).uniform(-1, 1) * most
    return max(timedelta(0), period + off)

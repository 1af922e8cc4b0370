"""Calls that may fail for a while."""

from __future__ import annotations

import time
from collections.abc import Callable


def retried(f: Callable, attempts: int = 3, pause: float = 0.0) -> Callable:
    """f, called up to `attempts` times until it raises nothing; what the last call raises is raised."""

    def call(*args):
        for k in range(attempts):
            try:
                return f(*args)
            except Exception:
                if k + 1 == attempts:
                    raise
                time.sleep(pause)

    return call


def or_none(f: Callable) -> Callable:
    """f, with None for what raises."""

    def call(*args):
        try:
            return f(*args)
        except Exception:
            return None

    return call

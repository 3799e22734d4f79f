"""What a Python worker remembers between tasks: the caches of one operator at a time."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa

_last: list[tuple[str, Callable[[], None]]] = []


def take(owner: str, clear: Callable[[], None]) -> None:
    """``owner`` is at work; what another one remembered is forgotten, so that a worker's memory does not add up."""
    if _last and _last[0][0] != owner:
        _last[0][1]()
        pa.default_memory_pool().release_unused()
    _last[:] = [(owner, clear)]

"""What Python workers remember between tasks.

Spark reuses its workers, so a memory of one operator would stay while another one runs. A worker
holds the memory of the operator that it ran last only: each operator names itself when its iterator
starts, and the memories of all others are emptied.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa

_held: dict[str, Callable[[], None]] = {}


def claim(owner: str, release: Callable[[], None] | None = None) -> None:
    """``owner`` runs in this worker now; ``release`` empties its memory when another one does."""
    for name in [name for name in _held if name != owner]:
        _held.pop(name)()
    if release is not None:
        _held[owner] = release


def trim() -> None:
    """Give what a task has freed back to the system: idle workers stay for a while."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass

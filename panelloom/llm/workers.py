"""What a Python worker keeps between tasks.

Spark reuses its Python workers, so what a kernel learned in one task helps the next.  A worker keeps the memo of one operator
at a time: the kernels of the others let go of it before they start.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable

import pyarrow as pa

_held: dict[Hashable, object] = {}


def held(key: Hashable, build: Callable[[], object]):
    """The object built under ``key`` by this worker, built now if it holds another one or none."""
    if key not in _held:
        release()
        _held[key] = build()
    return _held[key]


def release() -> None:
    """Let go of what is held, and give memory that is free back to the system: an idle worker is resident too."""
    if _held:
        _held.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass

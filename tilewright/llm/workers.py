"""What a Python worker holds from task to task. Spark reuses workers, several for each core, and idle ones keep their memory."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa

_KEPT: dict[tuple, Any] = {}


def kept(make: Callable[..., Any], *args: Any) -> Any:
    """make(*args), made once and kept for later tasks of this worker; what it kept before for other work goes."""
    key = (make, *args)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make(*args)
    return _KEPT[key]


def lean(batches: Iterator[Any], keeps: bool = False) -> Iterator[Any]:
    """The batches of a task. Unless the task keeps something itself, what the worker kept for other work goes first; after
    the last batch freed memory is given back to the system, which allocators otherwise hold for the worker's life."""
    if not keeps:
        _KEPT.clear()
    yield from batches
    give_back()


def give_back() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim:
        trim(0)

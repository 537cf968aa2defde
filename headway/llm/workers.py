"""Memory of the Python workers, which Spark keeps from one task to the next."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

#: What the tasks of a step leave to the next ones, by a name that steps share.
KEPT: dict[str, object] = {}


def begin(keeps: str | None) -> None:
    for name in [n for n in KEPT if n != keeps]:
        del KEPT[name]


def give_back() -> None:
    """Return what freed arrays have left with the allocators to the system; they would hold it while the JVM works."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def frugal(step: Step, keeps: str | None = None) -> Step:
    """The step for mapInArrow: it starts without what other steps keep, and leaves no freed memory behind."""
    def run(batches):
        begin(keeps)
        try:
            yield from step(batches)
        finally:
            give_back()

    return run

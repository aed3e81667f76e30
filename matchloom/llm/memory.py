"""Memory of Python workers, which are reused and must not hold between batches what no one uses."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # other C libraries give memory back by themselves
    _trim = None


def give_back() -> None:
    """Returns freed memory of Arrow's pool and of the C library to the system."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def in_parts(batches: Iterator[pa.RecordBatch], column: str, size: int, make: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """make of consecutive rows of at most size bytes in a string column (one row at least), then memory goes back."""
    for batch in batches:
        lengths = [x.as_buffer().size if x.is_valid else 0 for x in batch[column]]
        lo = total = 0
        for i, n in enumerate(lengths):
            if i > lo and total + n > size:
                yield make(batch.slice(lo, i - lo))
                lo, total = i, 0
            total += n
        if batch.num_rows > lo:
            yield make(batch.slice(lo))
        del batch
        give_back()

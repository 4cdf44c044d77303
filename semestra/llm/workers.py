"""Memory of Spark's Python workers, which go on from task to task and from
stage to stage: what one task held is given back at its end."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa

from semestra.llm import hashing

SLICE_ROWS = 512  # rows of a batch that are handled, and handed on, at a time
Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def release() -> None:
    """Give unused memory back to the system; the C library otherwise keeps
    what was freed between blocks that are still in use."""
    hashing.forget()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library has it
    if trim is not None:
        trim(0)


def tidy(run: Run) -> Run:
    """``run`` (for mapInArrow) that leaves no memory behind in its worker."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most SLICE_ROWS rows."""
    for batch in batches:
        for row in range(0, len(batch), SLICE_ROWS):
            yield batch.slice(row, SLICE_ROWS)

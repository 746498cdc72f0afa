"""Giving memory back between tasks: a Python worker outlives its task, and several stand idle beside the one at work."""

from __future__ import annotations

import ctypes
import functools
import gc

import pyarrow as pa


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run):
    """An Arrow function that releases memory at the end of each task."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped

"""Small helpers for functions that work on Arrow data inside tasks."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable

import numpy as np
import pyarrow as pa


def release() -> None:
    """Give memory of finished work back to the machine; a worker process would keep it while it waits for tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def per_group(fn: Callable, **fixed) -> Callable:
    """``fn(key, table, ...)`` with fixed arguments, for ``applyInArrow``."""

    def run(key, table):
        out = fn(key, table, **fixed)
        release()
        return out

    return run


def per_batches(fn: Callable, **fixed) -> Callable:
    """``fn(batches, ...)`` with fixed arguments, for ``mapInArrow``."""

    def run(batches):
        yield from fn(batches, **fixed)
        release()

    return run


def per_pair(fn: Callable, **fixed) -> Callable:
    """``fn(key, left, right, ...)`` with fixed arguments, for cogrouped ``applyInArrow``."""

    def run(key, left, right):
        out = fn(key, left, right, **fixed)
        release()
        return out

    return run


def packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def joined(column, dtype) -> np.ndarray:
    """All values of a column of packed arrays."""
    parts = [np.frombuffer(x, dtype) for x in column.to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)

"""Memory of Python workers: what a task frees goes back to the system."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache, wraps

import pyarrow as pa

#: ``mallopt`` parameters of the GNU C library, and the bytes from which a block is mapped by itself and given back when it is freed.
_TRIM, _MAP, _BYTES = -1, -3, 1 << 18


@cache
def _library() -> ctypes.CDLL | None:
    """Set up once in each worker; a driver does not come here. Without the GNU C library nothing changes."""
    pa.set_memory_pool(pa.system_memory_pool())  # the default pool keeps what it once had
    try:
        found = ctypes.CDLL(None)
        found.mallopt(_MAP, _BYTES)
        found.mallopt(_TRIM, _BYTES)
        found.malloc_trim  # noqa: B018
    except (OSError, AttributeError):
        return None
    return found


def give_back() -> None:
    """Spark keeps workers for later tasks, more of them than run at once, so a worker must not hold on to what its largest batch took."""
    if library := _library():
        library.malloc_trim(0)


def lean(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task over an iterator of batches that gives memory back as it ends."""

    @wraps(task)
    def run(batches):
        _library()
        yield from task(batches)
        give_back()

    return run

"""Word and window fingerprints of Arrow batches, for use inside tasks."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Texts of a batch are worked on in slices of about so many bytes.
SLICE_BYTES = 2 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


#: glibc's way to give freed memory back to the system; other systems have none.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None


def give_back() -> None:
    """Workers live on, and so would the memory that they have freed."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


#: What lets go of the things that operators remember in a worker from task to task.
forgetting: list[Callable[[], None]] = []


def make_room() -> None:
    """Other work begins in this worker, and what was remembered for the last is of no use to it."""
    for forget in forgetting:
        forget()
    give_back()


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches, before and after which memory is given back."""

    def each(batches: Iterator) -> Iterator:
        make_room()
        yield from run(batches)
        give_back()

    return each


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, base + SLICE_BYTES, side="right")))
        yield batch.slice(start, end - start)
        start = end
    give_back()


def word_lists(column: pa.Array, lower: bool) -> list[list[bytes]]:
    """Words of whole texts, split at the six ASCII spaces; lower() touches A-Z alone."""
    raw = column.cast(pa.large_binary()).to_pylist()
    if lower:
        return [r.lower().split() if r else [] for r in raw]
    return [r.split() if r else [] for r in raw]


def fingerprints(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit fingerprints of all words, one after another, and each text's bounds."""
    bounds = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum([len(w) for w in words], out=bounds[1:])
    flat = pa.array(chain.from_iterable(words), type=pa.large_binary(), size=int(bounds[-1])).dictionary_encode()
    known = np.array([xxhash.xxh3_64_intdigest(w) for w in flat.dictionary.to_pylist()], dtype=np.uint64)
    return (known[flat.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)), bounds


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of the windows of k words that start at each place (k - 1 fewer)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * _STEP + words[j : j + n]
    return mix(h + np.uint64(k))

"""Token ids of many texts at once: distinct chunks are encoded once, texts are gathered with numpy.

A ``ChunkTable`` maps chunks of text (which an encoder treats independently of their neighbours) to ids. Arrow
splits a batch of texts into chunks and finds the distinct ones; only chunks that the table has not met go to the
encoder. The table keeps ``LIMIT`` chunks of ``LIMIT_CHARS`` characters in all at most, and none longer than
``LONGEST``; others are encoded batch by batch and not kept.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LIMIT, LIMIT_CHARS, LONGEST = 200_000, 3_000_000, 128
BATCH_CHARS = 4 << 20

_held: dict = {}


def only(key, make: Callable):
    """The object of ``key``, kept for the next task of this worker; a worker keeps one, whatever operators it serves."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Drops what the worker keeps, and gives free memory back: workers serve one operator after another."""
    _held.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        return


class ChunkTable:
    def __init__(self, encode: Callable[[str], list[int]], limit: int = LIMIT):
        self.encode, self.limit = encode, limit
        self.known: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.uint32)
        self.starts = np.empty(1 << 14, np.int64)
        self.counts = np.empty(1 << 14, np.int64)
        self.kept = self.kept_ids = self.n = self.n_ids = self.chars = 0

    def _add(self, ids: list[int]) -> int:
        k, m = len(ids), self.n
        while self.n_ids + k > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        if m == len(self.starts):
            self.starts, self.counts = (np.concatenate([x, np.empty_like(x)]) for x in (self.starts, self.counts))
        self.ids[self.n_ids : self.n_ids + k] = ids
        self.starts[m], self.counts[m] = self.n_ids, k
        self.n_ids += k
        self.n += 1
        return m

    def slots(self, chunks: list[str]) -> np.ndarray:
        known, get = self.known, self.known.get
        out = np.fromiter((get(c, -1) for c in chunks), np.int64, len(chunks))
        # Those that are too long to be kept come last, where ``forget`` finds them.
        for i in sorted(np.flatnonzero(out < 0).tolist(), key=lambda i: len(chunks[i]) > LONGEST):
            out[i] = slot = self._add(self.encode(chunks[i]))
            size = len(chunks[i])
            if len(known) < self.limit and size <= LONGEST and self.chars + size <= LIMIT_CHARS:
                known[chunks[i]] = slot
                self.chars += size
                self.kept, self.kept_ids = self.n, self.n_ids
            elif size <= LONGEST:
                self.limit = 0  # full: nothing is kept from here on
        return out

    def forget(self) -> None:
        """Drops what was encoded for one batch only."""
        self.n, self.n_ids = self.kept, self.kept_ids

    def gather(self, slots: np.ndarray) -> np.ndarray:
        counts = self.counts[slots]
        shift = self.starts[slots] - np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(slots) else counts
        return self.ids[np.repeat(shift, counts) + np.arange(counts.sum())]


def text_blocks(texts: pa.Array, most: int = BATCH_CHARS) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of about ``most`` bytes each; a longer text stands alone. Nulls become empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield at, texts.take(pa.array(np.arange(at, to)))  # a copy: some kernels go wrong on slices of large strings
        at = to
        pa.default_memory_pool().release_unused()


def encode_chunks(table: ChunkTable, lists: pa.Array) -> list[np.ndarray]:
    """ids of each list of chunks, where the lists are Arrow's split texts."""
    flat = lists.flatten()
    codes = flat.dictionary_encode()
    slots = table.slots(codes.dictionary.to_pylist())[codes.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.empty(0, np.int64)
    ids = table.gather(slots)
    offsets = lists.offsets.to_numpy()
    ends = np.concatenate([[0], np.cumsum(table.counts[slots])])[offsets - offsets[0]]
    return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

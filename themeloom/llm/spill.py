"""Task-local structures that spill to unnamed temporary files, gone with the task that made them."""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Iterator

BLOCK = 4096


class SpillingQueue:
    """A priority queue of tuples, least first. Past `limit` entries its memory is written out as a sorted run."""

    def __init__(self, limit: int = 1 << 18):
        self.limit, self.heap, self.runs, self.written = limit, [], [], 0

    def push(self, item: tuple) -> None:
        if len(self.heap) >= self.limit:
            self._spill()
        heapq.heappush(self.heap, item)

    def _spill(self) -> None:
        run = _blocks(sorted(self.heap))
        self.heap = []
        heapq.heappush(self.runs, (next(run), self.written, run))
        self.written += 1

    def least(self) -> tuple | None:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            return self.runs[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            item, number, run = self.runs[0]
            following = next(run, None)
            if following is None:
                heapq.heappop(self.runs)
            else:
                heapq.heapreplace(self.runs, (following, number, run))
            return item
        return heapq.heappop(self.heap)


def _blocks(items: list[tuple]) -> Iterator[tuple]:
    """Writes items to a file and gives them back in order, a block at a time."""
    store = tempfile.TemporaryFile()
    for k in range(0, len(items), BLOCK):
        pickle.dump(items[k : k + BLOCK], store)
    store.seek(0)

    def read() -> Iterator[tuple]:
        with store:
            while True:
                try:
                    yield from pickle.load(store)
                except EOFError:
                    return

    return read()


class SpillingStack:
    """Items that come back last first. Past `limit` bytes, as the caller counts them, its memory becomes a block on disk."""

    def __init__(self, limit: int = 1 << 24):
        self.limit, self.held, self.items, self.places, self.store = limit, 0, [], [], None

    def push(self, item, size: int) -> None:
        self.items.append(item)
        self.held += size
        if self.held >= self.limit:
            self.store = self.store or tempfile.TemporaryFile()
            self.places.append(self.store.seek(0, 2))
            pickle.dump(self.items, self.store)
            self.items, self.held = [], 0

    def drain(self) -> Iterator:
        """All items from the last to the first; the stack is empty and usable again afterwards."""
        yield from reversed(self.items)
        for place in reversed(self.places):
            self.store.seek(place)
            yield from reversed(pickle.load(self.store))
        if self.store:
            self.store.close()
        self.held, self.items, self.places, self.store = 0, [], [], None

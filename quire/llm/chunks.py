"""A table of distinct chunks and their token ids, filled while a task reads its texts.

Natural text repeats its words: a task that segments each distinct chunk once and looks the
rest up does a small part of the work, and needs no shuffle of positions, which would move
several times the input. The table is bounded; when it is full it starts again.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

LIMIT = 400_000


class ChunkTable:
    """Ids of distinct chunks; ``encode`` turns a list of chunks into a list of id lists."""

    def __init__(self, encode: Callable[[list], list], limit: int = LIMIT):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.number: dict = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.begin = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _add(self, new: list) -> None:
        coded = self.encode(new)
        lengths = np.fromiter(map(len, coded), np.int64, len(new))
        flat = np.fromiter(chain.from_iterable(coded), np.int32, int(lengths.sum()))
        n, first = len(self.number), self.used
        self.used += len(flat)
        while self.used > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(new) > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])
        self.ids[first : self.used] = flat
        self.begin[n : n + len(new)] = first + np.cumsum(lengths) - lengths
        self.size[n : n + len(new)] = lengths
        self.number.update(zip(new, range(n, n + len(new))))

    def lookup(self, chunks: list) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in order, number of ids of each chunk): ids are joined back by position."""
        new = set(chunks).difference(self.number)
        if len(self.number) + len(new) > self.limit:
            self._clear()
            new = set(chunks)
        if new:
            self._add(list(new))
        at = np.fromiter(map(self.number.__getitem__, chunks), np.int64, len(chunks))
        size, begin = self.size[at], self.begin[at]
        ends = np.cumsum(size)
        flat = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - size), size)
        return self.ids[flat], size

"""Token ids of many texts at once, each distinct piece of text encoded only once per worker.

Natural text repeats its words, so an encoder that splits a text into independent pieces need not
run for each occurrence. A ``PieceCache`` numbers distinct pieces, keeps their ids end to end in
one array, and answers a whole batch of pieces with array look-ups.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable
from itertools import repeat

import numpy as np

# A worker forgets its pieces when it holds this many, which bounds its memory to some 200 MB.
MAX_PIECES = 700_000


class PieceCache:
    """``encode`` takes distinct unknown pieces; it returns their ids end to end and each one's count."""

    def __init__(
        self, encode: Callable[[list[Hashable]], tuple[np.ndarray, np.ndarray]], limit: int = MAX_PIECES
    ):
        self._encode = encode
        self._limit = limit
        self._clear()

    def _clear(self) -> None:
        self._slots: dict[Hashable, int] = {}
        self._ids = np.zeros(1 << 16, np.uint32)
        self._starts = np.zeros(1 << 14, np.int64)
        self._sizes = np.zeros(1 << 14, np.int64)
        self._used = 0

    def _learn(self, pieces: list[Hashable]) -> None:
        ids, sizes = self._encode(pieces)
        first, end = len(self._slots), self._used + len(ids)
        self._ids = _grown(self._ids, end)
        self._starts = _grown(self._starts, first + len(pieces))
        self._sizes = _grown(self._sizes, first + len(pieces))
        self._ids[self._used : end] = ids
        self._sizes[first : first + len(pieces)] = sizes
        self._starts[first : first + len(pieces)] = self._used + np.cumsum(sizes) - sizes
        self._slots.update(zip(pieces, range(first, first + len(pieces))))
        self._used = end

    def ids(self, pieces: list[Hashable], places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``pieces`` end to end, and how many each piece has.

        With ``places``, ``pieces`` are all distinct, and those meant are ``pieces[place]`` for each of these.
        """
        if len(self._slots) > self._limit:
            self._clear()
        known = self._slots.get
        slots = np.fromiter(map(known, pieces, repeat(-1)), np.int64, len(pieces))
        unknown = np.flatnonzero(slots < 0)
        if len(unknown):
            missing = [pieces[i] for i in unknown.tolist()]
            if places is None:
                self._learn(list(dict.fromkeys(missing)))
                slots[unknown] = np.fromiter(map(self._slots.__getitem__, missing), np.int64, len(missing))
            else:
                slots[unknown] = np.arange(len(missing)) + len(self._slots)
                self._learn(missing)
        if places is not None:
            slots = slots[places]
        sizes = self._sizes[slots]
        return self._ids[spans(self._starts[slots], sizes)], sizes


def _grown(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    larger = np.zeros(max(size, 2 * len(array)), array.dtype)
    larger[: len(array)] = array
    return larger


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indexes of the spans ``[start, start + size)``, end to end."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(total)


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over consecutive groups of ``counts`` values; a group may be empty."""
    ends = np.cumsum(counts)
    running = np.concatenate([[0], np.cumsum(values)])
    return running[ends] - running[ends - counts]

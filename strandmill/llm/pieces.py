"""Token ids of text pieces, each distinct piece encoded once per cache."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from strandmill.llm.text_arrays import gather_runs

#: Encodes pieces; returns all their ids in a row, and how many each has.
EncodePieces = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


#: Ids per piece, on average, that a full cache holds.
PIECE_IDS = 16


class PieceCache:
    """Remembers the ids of up to ``limit`` pieces, few where they are long; a fuller cache keeps only
    the pieces that are asked for just then."""

    def __init__(self, encode: EncodePieces, limit: int):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.lengths = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _keep(self, pieces: list[str]) -> None:
        """Forget all but these pieces."""
        at = self._places(pieces)
        ids, lengths = gather_runs(self.ids, self.starts[at], self.lengths[at]), self.lengths[at]
        self._clear()
        self._add(pieces, ids, lengths)

    def _places(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))

    def _add(self, pieces: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        known, total = len(self.index), len(self.index) + len(pieces)
        if total > len(self.starts):
            self.starts = np.resize(self.starts, 2 * total)
            self.lengths = np.resize(self.lengths, 2 * total)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * (self.used + len(ids)))
        self.starts[known:total] = self.used + np.cumsum(lengths) - lengths
        self.lengths[known:total] = lengths
        self.ids[self.used:self.used + len(ids)] = ids
        self.used += len(ids)
        self.index.update(zip(pieces, range(known, total)))

    def runs(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``ids`` each of these distinct pieces starts, and its length."""
        missing = [p for p in pieces if p not in self.index]
        if missing:
            if len(self.index) + len(missing) > self.limit or self.used > PIECE_IDS * self.limit:
                self._keep([p for p in pieces if p in self.index])
            self._add(missing, *self.encode(missing))
        at = self._places(pieces)
        return self.starts[at], self.lengths[at]

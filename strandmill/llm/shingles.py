"""Sets of hashed word shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from strandmill.llm.text_arrays import (
    hash_strings, mix, split_words, window_hashes, window_rows,
)

WIDTH = 5


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text in ascending order, and the offset of each text.

    A-Z count as a-z. A text with fewer than ``width`` words has its whole sequence as one
    shingle; one without words has none.
    """
    ids, distinct, offsets = split_words(texts, lower=True)
    words = hash_strings(distinct)[ids]
    starts, rows = window_rows(offsets, width)
    hashes = window_hashes(words, width)[starts]
    counts = np.diff(offsets)
    for size in range(1, width):
        short = np.flatnonzero(counts == size)
        if len(short):
            whole = mix(window_hashes(words, size)[offsets[short]] ^ np.uint64(size))
            hashes, rows = np.concatenate([hashes, whole]), np.concatenate([rows, short])
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    hashes, rows = hashes[fresh], rows[fresh]
    sizes = np.bincount(rows, minlength=len(counts))
    return hashes, np.concatenate([[0], np.cumsum(sizes)])

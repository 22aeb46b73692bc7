"""Texts of an Arrow batch as flat arrays: bounded slices, words, hashes of words and windows.

Only the distinct words of a slice ever become Python objects.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Arrays over a slice take some thirty times its text.
SLICE_BYTES = 2 << 20
#: Odd multipliers of a polynomial over words, and of the mixing step.
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)


def give_back() -> None:
    """Return memory that Arrow and the C library hold in reserve: workers live on after a task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_slices(
    batches: Iterable[pa.RecordBatch], column: str = "text", max_bytes: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``max_bytes`` of text, or one longer text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        give_back()


def column_texts(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The texts of a batch, null as the empty text."""
    return pc.fill_null(batch.column(column), "")


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The strings that lie one after another in these bytes."""
    return pa.Array.from_buffers(
        pa.large_string(), len(offsets) - 1,
        [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))],
    )


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, nulls as empty ones, and the offset of each."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0]:ends[-1]], ends - ends[0]


def encoded_lists(lists: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Lists of strings as ids, the distinct strings they name, and the offset of each list."""
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    encoded = lists.flatten().dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary, offsets


def split_words(
    texts: pa.Array, lower: bool = False
) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Runs of characters other than ASCII white space, as by ``encoded_lists``.

    ``lower`` maps A-Z to a-z and leaves all else as it is.
    """
    if lower:
        texts = pc.ascii_lower(texts)
    ids, distinct, offsets = encoded_lists(pc.ascii_split_whitespace(texts))
    empty = pc.index(distinct, "").as_py()
    if empty >= 0:
        real = ids != empty
        offsets = np.concatenate([[0], np.cumsum(real, dtype=np.int64)])[offsets]
        ids = ids[real]
    return ids, distinct, offsets


def hash_strings(strings: pa.Array) -> np.ndarray:
    return np.fromiter(
        map(xxhash.xxh3_64_intdigest, strings.to_pylist()), np.uint64, len(strings)
    )


def mix(values: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit integers in which every bit depends on all."""
    values = (values ^ (values >> np.uint64(30))) * MIX_A
    values = (values ^ (values >> np.uint64(27))) * MIX_B
    return values ^ (values >> np.uint64(31))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` neighbours, whether or not it crosses a border."""
    count = max(0, len(hashes) - width + 1)
    total = np.zeros(count, np.uint64)
    for step in range(width):
        total = total * STEP + hashes[step:step + count]
    return mix(total)


def window_rows(offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that lie in one row, and the row of each."""
    sizes = np.maximum(np.diff(offsets) - width + 1, 0)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    firsts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    starts = np.arange(sizes.sum()) - np.repeat(firsts - offsets[:-1], sizes)
    return starts, rows


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of integers by row."""
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[offsets])


def gather_runs(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` with these starts and lengths, one after another."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return flat[:0]
    return flat[np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)]

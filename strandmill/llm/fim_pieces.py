"""Fill-in-the-middle by a piece table.

A document is a row of descriptors (buffer, start, length) over two buffers that never change: the
texts of a batch and the sentinels. Cutting splits descriptors, an arrangement permutes them and
puts sentinels between, the inverse permutation restores, and digests read the buffers through
the descriptors. Text is only copied where a text is to be returned.

A row's draws depend on its id alone, so results do not depend on partitions. A null text is an
empty one; empty texts and texts that hold a sentinel are left plain. Rows with a null id draw as
the empty id. Repeated rows give repeated results; other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandmill.llm.text_arrays import gather_runs, strings, text_buffer, text_slices

#: Sentinels before the prefix, the suffix and the middle, and the forms.
SENTINELS = ("<P>", "<S>", "<M>")
FORMS = ("plain", "psm", "spm")
#: The parts of a document in the order of its text, and where each form puts them.
PREFIX, MIDDLE, SUFFIX = 0, 1, 2
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
#: The sentinel that goes before each part, by the part.
BEFORE = {PREFIX: "<P>", MIDDLE: "<M>", SUFFIX: "<S>"}

TEXT, MARK = 0, 1
_MARKS = np.frombuffer("".join(SENTINELS).encode(), np.uint8)
_MARK_AT = {s: 3 * i for i, s in enumerate(SENTINELS)}


class Settings(NamedTuple):
    """Of a hundred documents ``rate`` are rearranged, and of a hundred of those ``spm`` in that form."""

    seed: str = "1"
    rate: int = 90
    spm: int = 20


class Pieces(NamedTuple):
    """A row of ``k`` descriptors per document; those of length 0 hold nothing."""

    text: np.ndarray
    buffer: np.ndarray  # documents x k
    start: np.ndarray
    length: np.ndarray

    def permuted(self, rows: np.ndarray, order: list[int]) -> Pieces:
        """The descriptors of these documents in another order, without the others."""
        cut = np.ix_(rows, order)
        return Pieces(self.text, self.buffer[cut], self.start[cut], self.length[cut])

    def digests(self) -> list[str]:
        """SHA-256 of each document, read piece by piece."""
        buffers = (memoryview(self.text), memoryview(_MARKS))
        out = []
        for kinds, starts, lengths in zip(
            self.buffer.tolist(), self.start.tolist(), self.length.tolist()
        ):
            digest = hashlib.sha256()
            for kind, start, length in zip(kinds, starts, lengths):
                digest.update(buffers[kind][start:start + length])
            out.append(digest.hexdigest())
        return out

    def texts(self) -> pa.Array:
        """The documents as strings."""
        both = np.concatenate([_MARKS, self.text])
        starts = self.start + np.where(self.buffer == TEXT, len(_MARKS), 0)
        data = gather_runs(both, starts.ravel(), self.length.ravel())
        offsets = np.concatenate([[0], np.cumsum(self.length.sum(axis=1))])
        return strings(data, offsets)


def _counts(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flags are set before each of these places."""
    return np.concatenate([[0], np.cumsum(flags)])[at]


def token_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where tokens start: a run of letters A-Z, a-z is one, any other code point is one."""
    letter = (data | 32) - np.uint8(97) < 26
    inner = np.zeros(len(data), bool)
    inner[1:] = letter[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    inner[firsts] = False
    return np.flatnonzero(np.where(letter, ~inner, data & 0xC0 != 0x80))


def holds_sentinel(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text holds a sentinel."""
    named = (data[:-2] == 60) & (data[2:] == 62) & np.isin(data[1:-1], [80, 83, 77])
    at = np.flatnonzero(named) if len(data) > 2 else np.zeros(0, np.int64)
    rows = np.searchsorted(offsets, at, side="right") - 1
    found = np.zeros(len(offsets) - 1, bool)
    found[rows[at + 3 <= offsets[rows + 1]]] = True
    return found


def draws(ids: list, seed: str) -> np.ndarray:
    """Four unsigned 32-bit draws per id: the first 32 hex digits of the SHA-256 of seed:id."""
    raw = b"".join(
        hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids
    )
    return np.frombuffer(raw, ">u4").reshape(-1, 4).astype(np.int64)


def cut(data: np.ndarray, offsets: np.ndarray, ends: np.ndarray) -> Pieces:
    """One descriptor per document, split at these places: documents x 2 byte positions."""
    borders = np.column_stack([offsets[:-1], ends, offsets[1:]])
    start = borders[:, :-1]
    return Pieces(data, np.full(start.shape, TEXT), start, np.diff(borders, axis=1))


def arrange(pieces: Pieces, form: str, rows: np.ndarray) -> Pieces:
    """The documents' parts in a form, each behind its sentinel."""
    if form == "plain":
        return pieces.permuted(rows, [PREFIX, MIDDLE, SUFFIX])
    order = ORDERS[form]
    parts = pieces.permuted(rows, list(order))
    shape = (len(rows), 2 * len(order))
    buffer, start, length = (np.zeros(shape, np.int64) for _ in range(3))
    buffer[:, ::2], length[:, ::2] = MARK, 3
    start[:, ::2] = [_MARK_AT[BEFORE[p]] for p in order]
    buffer[:, 1::2], start[:, 1::2], length[:, 1::2] = parts.buffer, parts.start, parts.length
    return Pieces(pieces.text, buffer, start, length)


def restore(outputs: pa.Array, form: str) -> Pieces:
    """The texts that these outputs of a form were made from, as pieces of the outputs.

    An output is cut at its sentinels; no text that holds one was rearranged, so the first of
    each is the one that was put there.
    """
    data, offsets = text_buffer(outputs)
    if form == "plain":
        return cut(data, offsets, np.column_stack([offsets[1:], offsets[1:]]))
    order = ORDERS[form]
    view = data.tobytes()
    marks = [BEFORE[p].encode() for p in order]
    starts, ends = np.zeros((len(outputs), 3), np.int64), np.zeros((len(outputs), 3), np.int64)
    for row, (low, high) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        at = low
        for k, mark in enumerate(marks):
            found = view.find(mark, at, high)
            if found < 0:
                raise ValueError(f"an output of form {form} lacks {mark.decode()}")
            at = found + len(mark)
            starts[row, k] = at
            if k:
                ends[row, k - 1] = found
        ends[row, 2] = high
    pieces = Pieces(data, np.full(starts.shape, TEXT), starts, ends - starts)
    return pieces.permuted(np.arange(len(outputs)), np.argsort(order).tolist())


def _batch_columns(batch: pa.RecordBatch, settings: Settings, digests: bool) -> list[pa.Array]:
    data, offsets = text_buffer(batch.column("text"))
    starts = token_starts(data, offsets)
    firsts = np.searchsorted(starts, offsets)
    n = np.diff(firsts)
    drawn = draws(batch.column("doc_id").to_pylist(), settings.seed)
    units = np.sort(drawn[:, :2] % (n + 1)[:, None], axis=1)
    at = np.append(starts, len(data))[np.minimum(firsts[:-1, None] + units, len(starts))]
    ends = np.where(units == n[:, None], offsets[1:, None], at)
    pieces = cut(data, offsets, ends)
    plain = (n == 0) | holds_sentinel(data, offsets) | (drawn[:, 2] % 100 >= settings.rate)
    form = np.where(plain, 0, np.where(drawn[:, 3] % 100 < settings.spm, 2, 1))

    points = _counts(data & 0xC0 != 0x80, np.column_stack([offsets[:-1], ends]))
    sizes = np.diff(points, axis=1)
    found = [np.empty(len(n), object) for _ in range(2 if digests else 1)]
    for kind, name in enumerate(FORMS):
        rows = np.flatnonzero(form == kind)
        if not len(rows):
            continue
        arranged = arrange(pieces, name, rows)
        outputs = arranged.texts()
        if digests:
            found[0][rows] = arranged.digests()
            found[1][rows] = restore(outputs, name).digests()
        else:
            found[0][rows] = outputs.to_pylist()
    return [
        batch.column("doc_id"), pa.array(n), pa.array(np.array(FORMS, object)[form], pa.string()),
        *(pa.array(sizes[:, k], mask=plain) for k in (PREFIX, MIDDLE)),
        *(pa.array(column, pa.string()) for column in found),
    ]


def _run(docs: DataFrame, settings: Settings, names: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            columns = _batch_columns(batch, settings, len(names) == 2)
            yield pa.RecordBatch.from_arrays(
                columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", *names]
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n long, form string, prefix_chars long, middle_chars long"
    return docs.select("doc_id", "text").mapInArrow(
        run, schema + "".join(f", {name} string" for name in names)
    )


def rearranged(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Rows (doc_id, n, form, prefix_chars, middle_chars, output): each document in its form.

    ``n`` counts tokens; sizes are in code points and null where the form is plain.
    """
    return _run(docs, settings, ["output"])


def rearranged_digests(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """As ``rearranged``, with SHA-256 of the output and of the text restored from it and its form."""
    return _run(docs, settings, ["output_sha256", "restored_sha256"])


def restored(outputs: DataFrame) -> DataFrame:
    """Rows (doc_id, text) from rows (doc_id, form, output); a null output gives an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "output"):
            forms = np.array(batch.column("form").to_pylist(), object)
            forms[batch.column("output").is_null().to_numpy(zero_copy_only=False)] = None
            texts = np.full(batch.num_rows, "", object)
            for name in FORMS:
                rows = np.flatnonzero(forms == name)
                texts[rows] = restore(batch.column("output").take(pa.array(rows)), name).texts().to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"]
            )

    id_type = outputs.schema["doc_id"].dataType.simpleString()
    return outputs.select("doc_id", "form", "output").mapInArrow(
        run, f"doc_id {id_type}, text string"
    )

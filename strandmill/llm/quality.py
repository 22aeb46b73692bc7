"""Quality rules: base rules, and how much likelier a text is in trusted text than in the corpus.

Two multinomials over hashed word unigrams and bigrams are counted, one over all documents and
one over trusted documents. A document's score is the weighted mean log ratio of its n-grams, its own
counts left out of both. A few words that trusted text shuns, insults for one, hardly move a plain
mean, so unigrams with a ratio below ``TAIL`` weigh more. Ratios are fixed-point integers, so a score
depends on the text alone, not on how rows were batched.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmill.llm.store import SENT_IDS, how_to_send, semi_join, stored
from strandmill.llm.text_arrays import (
    column_texts, hash_strings, mix, row_sums, split_words, text_slices, window_hashes,
    window_rows,
)

BUCKET_BITS = 20
#: Hashed unigrams, then hashed bigrams.
N_BUCKETS = 2 << BUCKET_BITS
#: Counts are shuffled by ranges of buckets, each range of a task as one packed value.
RANGE_BITS = 13
FIXED_POINT = 1 << 20
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
MIN_WORDS = 50
MAX_REPEAT_PCT = 50
#: Documents that score less are not kept. Set, as are ``TAIL`` and its weight, with half of the trusted
#: documents held out.
MIN_SCORE = -0.5
#: Pseudo-counts that draw a bucket's ratio to 1 where there is little text.
PRIOR = 1
#: Unigrams with a log ratio below this count ``TAIL_WEIGHT`` times.
TAIL = -1.75
TAIL_WEIGHT = 32

JUDGED = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_words", T.LongType()),
    T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("kept", T.BooleanType()),
])


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Rows (doc_id, trusted), written once: ids whose labels all say good and none toxic.

    Null ids are left out.
    """
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    found = (
        labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min(F.coalesce(good, F.lit(False))).alias("trusted")).where("trusted")
    )
    return stored(found, "trusted-ids")


def _buckets(words: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of unigrams with their offsets, and of bigrams with their rows."""
    ids, distinct, offsets = words
    hashes = hash_strings(distinct)[ids]
    shift = np.uint64(64 - BUCKET_BITS)
    starts, rows = window_rows(offsets, 2)
    pairs = window_hashes(hashes, 2)[starts] >> shift
    return (
        (hashes >> shift).astype(np.int64), offsets,
        pairs.astype(np.int64) + (1 << BUCKET_BITS), rows,
    )


#: Columns of the table of counts.
COUNTED = ["bucket", "raw", "target"]
PACKED = "kind int, part int, cells binary"


def _count(batches: Iterator[pa.RecordBatch], kind: int) -> Iterator[pa.RecordBatch]:
    # A task reads far fewer than 2^32 n-grams.
    counts, one = np.zeros(N_BUCKETS, np.uint32), np.uint32(1)
    for batch in text_slices(batches):
        ones, _, twos, _ = _buckets(split_words(column_texts(batch)))
        for buckets in (ones, twos):
            np.add.at(counts, buckets, one)
    yield _packed(counts, kind)


def _packed(counts: np.ndarray, kind: int) -> pa.RecordBatch:
    """Rows (kind, part, cells): the buckets of each range that were found, with their counts."""
    found = np.flatnonzero(counts)
    parts, firsts = np.unique(found >> RANGE_BITS, return_index=True)
    cells = []
    for at in np.split(found, firsts[1:]) if len(found) else []:
        cells.append(_pack(np.stack([at, counts[at]])))
    kinds = np.full(len(parts), kind, np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(kinds), pa.array(parts.astype(np.int32)), pa.array(cells, pa.binary())],
        names=["kind", "part", "cells"],
    )


def _pack(table: np.ndarray) -> bytes:
    """Ascending buckets and their counts, one line each, as one value."""
    steps = table.astype("<i8", order="C")
    steps[0] = np.diff(steps[0], prepend=0)
    # Bytes of equal weight together: most are 0.
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    return zlib.compress(planes.tobytes(), 1)


def _unpacked(cells: bytes, lines: int = 2) -> np.ndarray:
    """Buckets and counts of a packed value, one line each."""
    planes = np.frombuffer(zlib.decompress(cells), np.uint8).reshape(8, -1)
    table = np.ascontiguousarray(planes.T).view("<i8").reshape(lines, -1).astype(np.int64)
    table[0] = np.cumsum(table[0])
    return table


def _sum_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``COUNTED`` from all packed values of some ranges."""
    width, sums = 1 << RANGE_BITS, {}
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("kind", "part"))
        for kind, part, cells in zip(*columns, batch.column("cells")):
            at, counts = _unpacked(cells.as_py())
            total = sums.setdefault(part, np.zeros((2, width), np.int64))
            total[kind, at - part * width] += counts
    for part, total in sums.items():
        found = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(found + part * width), *(pa.array(c[found]) for c in total)], names=COUNTED
        )


def ngram_counts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """Rows (bucket, raw, target): counts over all documents, and over the trusted ones.

    All documents are counted where they are read. ``trusted`` are the stored ids of ``trusted_ids``;
    only to count their texts do documents meet them.
    """
    texts = [docs.select("text"), semi_join(docs.select("doc_id", "text"), trusted, "doc_id").select("text")]
    raw, target = (
        part.mapInArrow(lambda batches, kind=kind: _count(batches, kind), PACKED)
        for kind, part in enumerate(texts)
    )
    return raw.unionAll(target).repartition("part").mapInArrow(
        _sum_ranges, ", ".join(f"{c} long" for c in COUNTED)
    )


@dataclass(frozen=True)
class Ratios:
    """Counts by bucket in the corpus and in trusted text."""

    raw: np.ndarray
    target: np.ndarray

    def scores(self, buckets: np.ndarray, own: np.ndarray, trusted: np.ndarray) -> np.ndarray:
        """Weighted log of the target count over the one that the corpus lets expect.

        ``own`` counts the document's own n-grams, which say nothing about the rest: they leave
        the corpus, and where ``trusted`` the target too. ``PRIOR`` is added to both, so buckets
        with little text say little. Fixed-point integers; all 0 without trusted text.
        """
        out = np.zeros(len(buckets))
        half = N_BUCKETS // 2
        for part, inside in ((slice(0, half), buckets < half), (slice(half, None), buckets >= half)):
            if self.target[part].any():
                share = self.target[part].sum(dtype=np.int64) / self.raw[part].sum(dtype=np.int64)
                at, left_out = buckets[inside], own[inside]
                rest = np.maximum(self.raw[at].astype(np.int64) - left_out, 0) * share
                of_target = self.target[at].astype(np.int64) - np.where(trusted[inside], left_out, 0)
                out[inside] = np.log((np.maximum(of_target, 0) + PRIOR) / (rest + PRIOR))
        weight = np.where((out < TAIL) & (buckets < half), TAIL_WEIGHT, 1)
        return np.round(out * FIXED_POINT).astype(np.int64) * weight


def _pack_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (most, cells): the largest count of a batch of ``COUNTED``, and the batch packed."""
    for batch in batches:
        if batch.num_rows:
            table = np.stack([c.to_numpy() for c in batch.columns])
            table = table[:, np.argsort(table[0], kind="stable")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([table[1:].max()]), pa.array([_pack(table)], pa.binary())], names=["most", "cells"]
            )


def log_ratios(counts: DataFrame) -> Ratios:
    """What ``ngram_counts`` found; a table of ``N_BUCKETS`` rows whatever the corpus.

    The rows are packed before they are sent to the driver, which fills the arrays in place. They
    are written first, so no task needs two Python workers, one that counts and one that packs.
    """
    table = stored(counts.select(COUNTED), "ngram-counts")
    packed = table.mapInArrow(_pack_counts, "most long, cells binary").collect()
    # Every task is sent these arrays, so they are as narrow as their counts allow.
    narrow = np.uint32 if all(row.most < 1 << 32 for row in packed) else np.int64
    wide = np.zeros((len(COUNTED) - 1, N_BUCKETS), narrow)
    for row in packed:
        bucket, *found = _unpacked(row.cells, len(COUNTED))
        wide[:, bucket] = found
    return Ratios(*wide)


def _repeat_words(words: tuple, width: int = 3) -> np.ndarray:
    """Words by row that lie in a window found at least twice in their row."""
    ids, distinct, offsets = words
    starts, rows = window_rows(offsets, width)
    keys = window_hashes(hash_strings(distinct)[ids], width)[starts]
    keys = mix(keys ^ mix(rows.astype(np.uint64)))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for step in range(width):
        covered[starts[twice] + step] = True
    return row_sums(covered, offsets)


def _text_counts(text: str) -> tuple[int, int, int]:
    raw = text.encode()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (
        len(text) - (len(raw) - len(raw.translate(None, SPACES))),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
    )


def measure(
    texts: pa.Array, ratios: Ratios, min_score: float, trusted: np.ndarray | None = None
) -> dict[str, np.ndarray]:
    """Columns of ``JUDGED`` but the id; ``trusted`` marks texts that the target counts."""
    words = split_words(texts)
    n_words = np.diff(words[2])
    ones, offsets, twos, rows = _buckets(words)
    owners = np.concatenate([np.repeat(np.arange(len(n_words)), n_words), rows])
    cells, own = np.unique(owners * N_BUCKETS + np.concatenate([ones, twos]), return_counts=True)
    of_target = np.zeros(len(cells), bool) if trusted is None else trusted[cells // N_BUCKETS]
    values = ratios.scores(cells % N_BUCKETS, own, of_target) * own
    of_row = np.searchsorted(cells, np.arange(len(n_words) + 1) * N_BUCKETS)
    sizes = n_words + np.bincount(rows, minlength=len(n_words))
    score = row_sums(values, of_row) / (np.maximum(sizes, 1) * float(FIXED_POINT))
    repeats = _repeat_words(words)
    failed = (n_words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PCT * n_words)
    counts = np.array(list(map(_text_counts, texts.to_pylist())), np.int64).reshape(-1, 3)
    return {
        "n_words": n_words, "word_chars": counts[:, 0], "n_symbols": counts[:, 1],
        "n_dup_lines": counts[:, 2], "n_repeat_words": repeats, "base_failed": failed,
        "score": score, "kept": ~failed & (score >= min_score),
    }


def _flagged(docs: DataFrame, trusted: DataFrame, flag: str) -> DataFrame:
    """``docs`` with a last column that marks trusted ids."""
    marks = trusted.select(F.col("doc_id").alias(f"{flag}_id"), F.col("trusted").alias(flag))
    marks = marks.hint(how_to_send(trusted, SENT_IDS))
    joined = docs.join(marks, docs["doc_id"] == marks[f"{flag}_id"], "left")
    return joined.select(*(docs[c] for c in docs.columns), F.coalesce(marks[flag], F.lit(False)).alias(flag))


def _measured(batch: pa.RecordBatch, ratios: Ratios, min_score: float, flag: str) -> dict[str, np.ndarray]:
    trusted = batch.column(flag).to_numpy(zero_copy_only=False).astype(bool)
    return measure(column_texts(batch), ratios, min_score, trusted)


def judge(docs: DataFrame, ratios: Ratios, trusted: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """One row per document: base counts, score and verdict.

    ``trusted`` are the ids that ``ratios`` was counted with. A null or empty text has no words:
    all counts and the score are 0 and it fails the base rules. Null and repeated ids are rows like
    any other; of a trusted id each row leaves out its own counts. Other columns are not looked at.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            found = _measured(batch, ratios, min_score, "trusted")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, found.values())], names=JUDGED.names
            )

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return _flagged(rows, trusted, "trusted").mapInArrow(run, JUDGED)


def keep_good(docs: DataFrame, ratios: Ratios, trusted: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents whose verdict, as by ``judge``, is to keep them, with all their columns.

    Null and empty texts go; null and repeated ids are rows like any other.
    """
    columns = docs.columns
    flag = "trusted"
    while {flag, f"{flag}_id"} & {c.lower() for c in columns}:
        flag += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            kept = _measured(batch, ratios, min_score, flag)["kept"]
            yield batch.select(columns).filter(pa.array(kept))

    return _flagged(docs, trusted, flag).mapInArrow(run, docs.schema)

"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text. A word begins a chunk if the hash at its first byte
is the least among the words around it, so borders depend on nearby text alone: text inserted
before a passage leaves its chunks as they are. Where a few words are repeated over and over no
hash is least, and every few rounds begin a chunk. Chunks are compared by digest. A run of chunks
that all occur elsewhere in the corpus is a repeated passage if it has enough words; all its
occurrences but the first are repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.llm.store import stored
from strandmill.llm.text_arrays import column_texts, text_slices

#: A chunk begins at the least hash among this many words on either side.
REACH = 3
#: A passage is a run of repeated chunks with at least this many words.
MIN_WORDS = 20
#: Words at least from one border to the next where a few words are repeated over and over.
ROUND_WORDS = 4
#: Bytes that a 16-bit gear hash remembers.
MEMORY = 16
PAD = 0xFF  # in no UTF-8 text
SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
CHUNKS = (
    "doc_id long, version int, at int, start int, stop int, n_words int, hi long, lo long, again boolean"
)


def _gear() -> np.ndarray:
    """A pseudo-random number for each byte, and 0 for the padding."""
    numbers = (xxhash.xxh32_intdigest(bytes([b])) & 0xFFFF for b in range(256))
    table = np.fromiter(numbers, np.uint16, 256)
    table[PAD] = 0
    return table


GEAR = _gear()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte the gear hash: twice the last one plus the byte's number."""
    hashes = GEAR[data]
    width = 1
    while width < MEMORY:
        earlier = np.zeros_like(hashes)
        earlier[width:] = hashes[:-width]
        hashes = hashes + (earlier << np.uint16(width))
        width *= 2
    return hashes


def _round_borders(begins: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Of the words ``equal``, as small as the least around them, those that begin a chunk too.

    Equal hashes so near each other mean that the text goes round in up to ``REACH`` words.
    As many whole rounds as have ``ROUND_WORDS`` make a chunk, so it does not matter
    which round a chunk begins with.
    """
    at = np.flatnonzero(equal & ~begins)
    if not len(at):
        return begins
    chunk = np.cumsum(begins)[at]
    period = np.diff(at, prepend=at[0] - 1)
    fresh = np.concatenate([[True], (chunk[1:] != chunk[:-1]) | (period[1:] > REACH)])
    firsts = np.flatnonzero(fresh)
    rank = np.arange(len(at)) - np.repeat(firsts, np.diff(np.append(firsts, len(at))))
    out = begins.copy()
    out[at[fresh | (rank % -(-ROUND_WORDS // period) == 0)]] = True
    return out


def chunk_texts(texts: list[bytes], rounds: bool = False) -> tuple[np.ndarray, ...]:
    """Row, byte range, words and digest (two halves) of every chunk of the texts.

    A chunk's range ends with its last word. ``rounds`` also cuts where a few words are
    repeated over and over; else such a stretch lies in one chunk with its surroundings.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    pad = bytes([PAD]) * MEMORY
    whole = pad + b"".join(t + pad for t in texts)
    bases = MEMORY + np.cumsum(sizes + MEMORY) - (sizes + MEMORY)
    data = np.frombuffer(whole, np.uint8)
    inside = ~(SPACE[data] | (data == PAD))
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    rows = np.searchsorted(bases, starts, side="right") - 1
    # Words of different texts are set apart by REACH places that hold the largest number.
    place = np.arange(len(starts)) + REACH * (1 + rows)
    lane = np.full(len(starts) + REACH * (len(texts) + 2), 0xFFFF, np.uint16)
    lane[place] = gear_hashes(data)[starts]
    own = lane[place]
    begins, equal = np.ones((2, len(starts)), bool)
    for step in range(1, REACH + 1):
        equal &= (own <= lane[place - step]) & (own <= lane[place + step])
        begins &= (own < lane[place - step]) & (own <= lane[place + step])
    if len(starts):
        begins[np.concatenate([[True], rows[1:] != rows[:-1]])] = True
    if rounds:
        begins = _round_borders(begins, equal)
    first = np.flatnonzero(begins)
    last = np.append(first[1:], len(starts))[:len(first)] - 1
    begin, stop = starts[first], ends[last]
    view = memoryview(whole)
    digests = [xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(begin.tolist(), stop.tolist())]
    halves = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
    rows = rows[first]
    return rows, begin - bases[rows], stop - bases[rows], last - first + 1, halves[:, 0], halves[:, 1]


def text_version(texts: list[bytes]) -> np.ndarray:
    """Tells different texts of one id apart."""
    return np.fromiter(map(xxhash.xxh32_intdigest, texts), np.uint32, len(texts)).view(np.int32)


def _again(rows: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Whether a chunk's digest occurs earlier in its row."""
    order = np.lexsort((np.arange(len(rows)), lo, hi, rows))
    same = (
        (rows[order][1:] == rows[order][:-1]) & (hi[order][1:] == hi[order][:-1])
        & (lo[order][1:] == lo[order][:-1])
    )
    again = np.zeros(len(rows), bool)
    again[order[1:][same]] = True
    return again


def chunks(docs: DataFrame) -> DataFrame:
    """Rows of all chunks: doc_id, text version, number, byte range, words, digest, whether the
    text had it before."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            texts = [t.encode() for t in column_texts(batch).to_pylist()]
            rows, start, stop, n_words, hi, lo = chunk_texts(texts, rounds=True)
            if not len(rows):
                continue
            firsts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            at = np.arange(len(rows)) - np.repeat(firsts, np.diff(np.append(firsts, len(rows))))
            small = [pa.array(v.astype(np.int32)) for v in (at, start, stop, n_words)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows)),
                    pa.array(text_version(texts)[rows]), *small, pa.array(hi), pa.array(lo),
                    pa.array(_again(rows, hi, lo)),
                ],
                names=["doc_id", "version", "at", "start", "stop", "n_words", "hi", "lo", "again"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, CHUNKS)


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (doc_id, version, start, stop, n_words, first_doc, is_first) of all repeated passages.

    ``start`` and ``stop`` are byte offsets in the UTF-8 text, and passages of a text do not
    touch. ``is_first`` marks passages that no smaller doc_id, and nothing earlier in the text,
    has; the others are what to remove. ``version`` is a hash of the text, for ids with several. ``first_doc`` is the smallest id of another document
    that a chunk of the passage is in, or the text's own where it repeats itself. Null and empty
    texts and texts without a word have no passages. Rows that share an id, or have none, count
    as copies of one document: they are never repeats of each other. Other columns are
    not looked at.
    """
    table = stored(chunks(docs), "chunks")
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    repeated = (
        table.groupBy("hi", "lo")
        .agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high"),
             F.max(F.col("again").cast("int")).alias("inner"))
        .where("low < high or inner = 1").select("hi", "lo", "low", "high")
    )
    first = (key == F.col("low")) & ~F.col("again")
    other = F.when(F.col("low") < key, F.col("low")).otherwise(F.col("high"))
    marked = table.join(repeated, ["hi", "lo"]).select(
        "doc_id", "version", "at", "start", "stop", "n_words", first.alias("is_first"), other.alias("other")
    ).where("doc_id is not null")
    return _runs(marked).where(F.col("n_words") >= min_words)


def _runs(marked: DataFrame) -> DataFrame:
    """Passages from repeated chunks: neighbours that are all first occurrences, or all not."""
    of_text = Window.partitionBy("doc_id", "version", "is_first").orderBy("at")
    run = F.col("at") - F.dense_rank().over(of_text)  # repeated rows share chunk numbers
    return (
        marked.withColumn("run", run).groupBy("doc_id", "version", "is_first", "run")
        .agg(
            F.min("start").alias("start"), F.max("stop").alias("stop"),
            F.min("other").alias("first_doc"),
            _words_once().alias("n_words"),
        )
        .select("doc_id", "version", "start", "stop", "n_words", "first_doc", "is_first")
    )


def _words_once() -> Column:
    """Words of a run, each chunk once however many rows share id and text."""
    copies = F.count("*") / F.count_distinct("at")
    return F.round(F.sum("n_words") / copies).cast("int")


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeats cut out of ``text`` and ``n_chars`` counted anew.

    Each passage stays where it occurs first. A text that loses all its words is dropped;
    texts without repeats, null and empty ones among them, stay as they are. Rows that share an
    id lose what repeats in their own text; repeated rows stay repeated. Other columns are handed on.
    """
    columns = docs.columns
    cut_id, ranges_at = _unused("cut_id", columns), len(columns)
    cuts = (
        repeated_passages(docs, min_words).where("not is_first and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_set(F.struct("version", "start", "stop"))).alias("cuts"))
        .select(F.col("doc_id").alias(cut_id), F.col("cuts").alias(_unused("cuts", columns)))
    )
    text_at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            texts = batch.column(text_at).to_pylist()
            keep, cut = np.ones((2, len(texts)), bool)
            for i, ranges in enumerate(batch.column(ranges_at).to_pylist()):
                raw = (texts[i] or "").encode()
                version = text_version([raw])[0] if ranges else 0
                own = [(c["start"], c["stop"]) for c in ranges or [] if c["version"] == version]
                cut[i] = bool(own)
                if own:
                    texts[i] = cut_out(raw, own)
                    keep[i] = bool(texts[i].strip())
            arrays = batch.columns[:len(columns)]
            arrays[text_at] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                at = columns.index("n_chars")
                sizes = [len(t) if c else n for n, t, c in zip(arrays[at].to_pylist(), texts, cut)]
                arrays[at] = pa.array(sizes, arrays[at].type)
            yield pa.RecordBatch.from_arrays(arrays, names=columns).filter(pa.array(keep))

    return docs.join(cuts, docs["doc_id"] == cuts[cut_id], "left").drop(cut_id).mapInArrow(run, docs.schema)


def _unused(name: str, columns: list[str]) -> str:
    """The name, or a longer one that no column has in any case."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def cut_out(text: bytes, ranges: list[tuple[int, int]]) -> str:
    parts, at = [], 0
    for start, stop in ranges:
        parts.append(text[at:max(at, start)])
        at = max(at, stop)
    return b"".join([*parts, text[at:]]).decode()

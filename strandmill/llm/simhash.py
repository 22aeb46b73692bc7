"""Near copies by SimHash: every pair of fingerprints in tiles, compared exactly.

Equal fingerprints are put together first, so copies cost nothing further. Distinct fingerprints
lie in tiles by their population count (the number of bits set); two fingerprints differ in at
least as many bits as their counts do, so tile pairs beyond the radius are never made. A task
takes one pair of tiles. It files their fingerprints under the counts of four quarters, skips
those whose quarters are too far apart in sum, and compares all others by exclusive-or and bit
counts. It passes on a spanning forest of what it found, not all links; components are the same.

Tiles keep memory bounded. The number of comparisons grows with the square of the number of
distinct fingerprints, less what the counts rule out: the method is exact for any radius and
any data, and meant for corpora of some ten million distinct documents.

A null text is an empty one, with the fingerprint zero. Rows are nodes: repeated rows, and
different texts under one id, have a row each. Rows with a null id get a fingerprint and a null
component, and link nothing. Other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.components import connected_components
from strandmill.llm.store import stored
from strandmill.llm.text_arrays import column_texts, gather_runs, split_words, text_slices
from strandmill.operators.skew import lookup_join

WIDTH, RADIUS, SEED = 4, 4, 42
BITS = 64
#: Fingerprints of a tile, in the mean; a pair of tiles takes 1 MB.
TILE = 1 << 16
#: Fingerprints compared at once.
BLOCK = 1 << 21
QUARTER = np.uint64(0xFFFF)


# ------------------------------------------------------------------------- fingerprints

def shingle_hashes(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of each text, repeats included, and the offset of each text."""
    ids, distinct, offsets = split_words(texts, lower=True)
    sizes = pc.binary_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)[ids]
    spaced = pc.binary_join(pa.ListArray.from_arrays(
        pa.array([0, len(ids)], pa.int32()), distinct.take(pa.array(ids))), " ")
    data = (spaced[0].as_py() or "").encode()
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    counts = np.diff(offsets)
    found = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    ends = np.concatenate([[0], np.cumsum(found)])
    first = np.arange(ends[-1]) + np.repeat(offsets[:-1] - ends[:-1], found)
    last = first + np.repeat(np.minimum(counts, width), found)
    digest = xxhash.xxh64_intdigest
    view = memoryview(data)
    hashes = np.fromiter(
        (digest(view[a:b], SEED) for a, b in zip(starts[first].tolist(), (starts[last] - 1).tolist())),
        np.uint64, len(first),
    )
    return hashes, ends


def bit_majorities(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bits that are set in over half of each run of hashes; zero for an empty run."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    filled = np.flatnonzero(np.diff(offsets))
    if not len(filled):
        return out
    half = np.diff(offsets)[filled] / 2
    for bit in range(BITS):
        ones = np.add.reduceat((hashes >> np.uint64(bit)) & np.uint64(1), offsets[filled])
        out[filled] |= (ones > half).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows (doc_id, bits): the fingerprint of each row as a long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            bits = bit_majorities(*shingle_hashes(column_texts(batch), width))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(bits.view(np.int64))], ["doc_id", "bits"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, bits long")


# ---------------------------------------------------------------------- comparing tiles

def _quarters(prints: np.ndarray) -> np.ndarray:
    parts = [(prints >> np.uint64(16 * k)) & QUARTER for k in range(4)]
    return np.bitwise_count(np.stack(parts, axis=1)).astype(np.int16)


class Filed:
    """Fingerprints in the order of their quarters' counts, and the runs that share them."""

    def __init__(self, prints: np.ndarray):
        quarters = _quarters(prints)
        self.order = np.lexsort(quarters.T)
        self.prints, quarters = prints[self.order], quarters[self.order]
        fresh = np.ones(len(prints), bool)
        fresh[1:] = (quarters[1:] != quarters[:-1]).any(axis=1)
        self.starts = np.flatnonzero(fresh)
        self.ends = np.append(self.starts[1:], len(prints))
        self.counts = quarters[self.starts]


def close_pairs(left: Filed, right: Filed, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs, one of each side, that differ in at most ``radius`` bits."""
    runs = np.arange(len(right.prints))
    for start, end, counts in zip(left.starts, left.ends, left.counts):
        near = np.abs(right.counts - counts).sum(axis=1) <= radius
        if not near.any():
            continue
        at = gather_runs(runs, right.starts[near], (right.ends - right.starts)[near])
        step = max(1, BLOCK // len(at))
        for low in range(start, end, step):
            mine = left.prints[low:min(end, low + step)]
            far = np.bitwise_count(mine[:, None] ^ right.prints[at])
            i, j = np.nonzero(far <= radius)
            if len(i):
                yield left.order[low + i], right.order[at[j]]


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels in which each pair has one in common; a label is the least position it stands for."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label[label] != label).any():
            label = label[label]


def forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the close pairs of two tiles, or of one, connect."""
    both = left if right is None else np.concatenate([left, right])
    label = np.arange(len(both))
    mine = Filed(left)
    other, shift = (mine, 0) if right is None else (Filed(right), len(left))
    for i, j in close_pairs(mine, other, radius):
        label = unite(label, i, j + shift)
    moved = np.flatnonzero(label != np.arange(len(both)))
    return both[moved], both[label[moved]]


def _compare(radius: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        prints = rows.column("bits").to_numpy().view(np.uint64)
        second = rows.column("second").to_numpy(zero_copy_only=False)
        alone = not second.any()
        a, b = forest(prints[~second], None if alone else prints[second], radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return run


def _tiles_of_counts(distinct: DataFrame, tile: int) -> dict[int, int]:
    """How many tiles the fingerprints of each population count fill; 65 counts at most."""
    found = distinct.groupBy(F.bit_count("bits").alias("ones")).count().collect()
    return {row["ones"]: -(-row["count"] // tile) for row in found}


def close_links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all within ``radius``.

    ``distinct`` is a stored table with a column ``bits``. A fingerprint goes to a tile by a
    hash, so tiles of one count fill alike, and then to all pairs its tile is in.
    """
    tiles = _tiles_of_counts(distinct, tile)
    if not tiles:
        return distinct.select(F.col("bits").alias("a"), F.col("bits").alias("b"))
    near = {
        ones: [(other, k) for other in range(ones - radius, ones + radius + 1)
               for k in range(tiles.get(other, 0))]
        for ones in tiles
    }
    partners = distinct.sparkSession.createDataFrame(
        [(ones, n, near[ones]) for ones, n in tiles.items()],
        "ones int, tiles long, partners array<struct<ones: int, slice: long>>",
    )
    placed = (
        distinct.select("bits", F.bit_count("bits").alias("ones")).join(F.broadcast(partners), "ones")
        .select("bits", F.struct(F.col("ones"), F.pmod(F.xxhash64("bits"), "tiles").alias("slice")).alias("own"),
                F.explode("partners").alias("partner"))
        .select(F.least("own", "partner").alias("low"), F.greatest("own", "partner").alias("high"),
                (F.col("own") > F.col("partner")).alias("second"), "bits")
    )
    return placed.groupBy("low", "high").applyInArrow(_compare(radius), "a long, b long")


# ------------------------------------------------------------------------------ results

def near_copies(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id).

    Rows link if their fingerprints differ in at most ``radius`` bits; the component is the least
    id that links reach. Fingerprints are written in 16 lower-case hex digits.
    """
    prints = stored(fingerprints(docs, width), "fingerprints")
    distinct = stored(
        prints.where("doc_id IS NOT NULL").groupBy("bits").agg(F.min("doc_id").alias("least_id")),
        "distinct",
    )
    labels = connected_components(close_links(distinct, radius, tile))
    labelled = distinct.join(labels.withColumnRenamed("key", "bits"), "bits", "left").select(
        "bits", "least_id", F.coalesce("label", "bits").alias("label")
    )
    least = labelled.groupBy("label").agg(F.min("least_id").alias("component_id"))
    components = labelled.join(least, "label").select("bits", "component_id")
    # A fingerprint may hold any share of the rows: copies, or empty texts.
    return lookup_join(prints, components, ["bits"], "left", salt_on=["doc_id"]).select(
        "doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )

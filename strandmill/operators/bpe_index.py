"""Coded texts in buckets beside an index of the pairs each bucket holds.

Once merges are rare, a training pass looks up the buckets that hold its pairs, reads and
rewrites only those, and writes how their counts change. Buckets that are not looked up hold none
of the pairs, so their texts stay right as they are. Changes are added to the index and to the
totals when they are read, and folded in every ``PASSES_PER_FOLD`` passes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.operators.bpe_kernel import replace_all, weighted_pairs
from strandmill.session import fresh_path, remove

# Characters of a bucket, in the mean, and buckets at most: their places are kept by the driver.
BUCKET_CHARS = 1_000_000
MAX_BUCKETS = 4096
PASSES_PER_FOLD = 16
TEXTS = "bucket int, text string, copies bigint"
COUNTS = "bucket int, pair string, cnt bigint"
# Where a pass puts its changes; texts go to the folder of their bucket.
CHANGES = -1


def bucket_number(chars: int, least: int) -> int:
    """Buckets for so many characters of distinct texts."""
    return max(1, min(MAX_BUCKETS, max(least, chars // BUCKET_CHARS)))


def _by_bucket(record: pa.RecordBatch):
    """Texts and copies of each bucket in a batch."""
    bucket = record.column("bucket").to_numpy(zero_copy_only=False)
    texts = np.array(record.column("text").to_pylist(), dtype=object)
    copies = record.column("copies").to_numpy(zero_copy_only=False)
    for b in np.unique(bucket).tolist():
        at = np.flatnonzero(bucket == b)
        yield b, texts[at].tolist(), copies[at]


def _count_task(batches):
    for record in batches:
        for b, texts, copies in _by_bucket(record):
            pairs, cnt = weighted_pairs(texts, copies)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b] * len(pairs), pa.int32()), pa.array(pairs, pa.string()), pa.array(cnt)],
                ["bucket", "pair", "cnt"],
            )


def _merge_task(merges: list[tuple[str, str]]):
    """Rows of both kinds: all texts after the merges, and counts before (negative) and after."""
    names = ["part", "bucket", "text", "copies", "pair", "cnt"]

    def rows(part: int, b: int, n: int, **columns) -> pa.RecordBatch:
        kinds = {"text": pa.string(), "copies": pa.int64(), "pair": pa.string(), "cnt": pa.int64()}
        return pa.RecordBatch.from_arrays(
            [pa.array([part] * n, pa.int32()), pa.array([b] * n, pa.int32())]
            + [pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in kinds.items()],
            names,
        )

    def task(batches):
        for record in batches:
            for b, texts, copies in _by_bucket(record):
                hit = [i for i, t in enumerate(texts) if any(p in t for p, _ in merges)]
                before = [texts[i] for i in hit]
                after = replace_all(before, merges)
                for i, text in zip(hit, after):
                    texts[i] = text
                yield rows(b, b, len(texts), text=texts, copies=copies)
                for some, weight in ((before, -copies[hit]), (after, copies[hit])):
                    pairs, cnt = weighted_pairs(some, weight)
                    yield rows(CHANGES, b, len(pairs), pair=pairs, cnt=cnt)

    return task


class PairIndex:
    """Texts (text, copies) with their pairs, kept up to date merge by merge.

    ``touched`` has, for each pass, how many buckets were read.
    """

    def __init__(self, words: DataFrame, buckets: int):
        self.spark, self.buckets = words.sparkSession, buckets
        self.touched: list[int] = []
        first = fresh_path(self.spark, "bpe-buckets")
        bucket = F.pmod(F.xxhash64("text"), F.lit(buckets)).cast("int")
        placed = words.select(bucket.alias("bucket"), bucket.alias("part"), "text", "copies")
        placed.repartition("bucket").write.partitionBy("part").parquet(first)
        self.place = {r[0]: first for r in self.spark.read.parquet(first).select("part").distinct().collect()}
        texts = self.spark.read.schema(TEXTS).parquet(first)
        self._changes: list[str] = []
        self._store(texts.mapInArrow(_count_task, COUNTS))

    def _store(self, counts: DataFrame) -> None:
        """Write the index, in the order of its pairs, and the totals anew."""
        index, totals = fresh_path(self.spark, "bpe-index"), fresh_path(self.spark, "bpe-totals")
        counts.groupBy("pair", "bucket").agg(F.sum("cnt").alias("cnt")).where("cnt > 0").repartitionByRange(
            "pair").sortWithinPartitions("pair").write.parquet(index)
        self._index = index
        self._read(index).groupBy("pair").agg(F.sum("cnt").alias("cnt")).write.parquet(totals)
        self._totals = totals

    def _read(self, *paths: str) -> DataFrame:
        return self.spark.read.schema(COUNTS).parquet(*paths).select("pair", "bucket", "cnt")

    def counts(self) -> DataFrame:
        """Rows (pair, cnt) of all pairs that occur."""
        total = self.spark.read.schema("pair string, cnt bigint").parquet(self._totals)
        if self._changes:
            total = total.unionByName(self._read(*self._changes).select("pair", "cnt"))
        return total.groupBy("pair").agg(F.sum("cnt").alias("cnt")).where("cnt > 0")

    def holders(self, pairs: list[str]) -> list[int]:
        """Buckets that hold one of the pairs; the index is read where these are sorted."""
        rows = self._read(self._index, *self._changes).where(F.col("pair").isin(pairs))
        found = rows.groupBy("pair", "bucket").agg(F.sum("cnt").alias("cnt")).where("cnt > 0")
        return sorted(r[0] for r in found.select("bucket").distinct().collect())

    def merge(self, merges: list[tuple[str, str]]) -> None:
        """Make these replacements (pair, product), which do not influence each other."""
        found = self.holders([pair for pair, _ in merges])
        self.touched.append(len(found))
        if not found:
            return
        version = fresh_path(self.spark, "bpe-pass")
        texts = self.spark.read.schema(TEXTS).parquet(*(f"{self.place[b]}/part={b}" for b in found))
        schema = "part int, bucket int, text string, copies bigint, pair string, cnt bigint"
        texts.mapInArrow(_merge_task(merges), schema).write.partitionBy("part").parquet(version)
        for b in found:
            remove(self.spark, f"{self.place[b]}/part={b}")
            self.place[b] = version
        self._changes.append(f"{version}/part={CHANGES}")
        if len(self._changes) >= PASSES_PER_FOLD:
            self._fold()

    def _fold(self) -> None:
        old = [self._index, self._totals, *self._changes]
        self._store(self._read(self._index, *self._changes))
        self._changes = []
        for path in old:
            remove(self.spark, path)

    def texts(self) -> DataFrame:
        """Rows (bucket, text, copies) as they are now."""
        return self.spark.read.schema(TEXTS).parquet(*(f"{p}/part={b}" for b, p in sorted(self.place.items())))

"""Token files: ids ranked by frequency, in one to four bytes each, with separate control bytes.

A file row holds one document. Its control bytes give the byte lengths of four ids each, two bits
an id, lowest bits first; its data bytes are the ranks, low byte first. Rank 0 is the corpus's
most frequent token, so the 256 most frequent ones take one byte. Files are Parquet, one folder
``shard=N`` per range of doc_id; shards and the rows in them are in ascending doc_id order, and
``first`` counts the ids before a row in its shard. The folder ``ranks`` next to them gives
the token id of each rank.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm.pieces import PieceCache
from strandmill.llm.store import stored
from strandmill.llm.text_arrays import column_texts, encoded_lists, gather_runs, text_slices
from strandmill.session import fresh_path

END_ID = 0
#: A text is cut before single spaces and line feeds, and between a letter and a mark, where
#: byte-level pre-tokenizers with the usual pattern always cut. Texts with other white space are
#: encoded in one go, and so is every text if the tokenizer is of another kind.
LETTER_THEN_MARK = r"([A-Za-zÀ-ÖØ-öø-ÿ])([,.!?:;$#%*&)|])"
WHOLE_ONLY = (
    r"[\x00-\x08\t\x0b-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}"
    r"\x{205f}-\x{2064}\x{3000}\x{feff}]|[ \n][ \n]|^[ \n]|[ \n]$"
)
MARK = "\x01"
JOINED_PIECES = 2000
CACHED_PIECES = 500_000
#: Larger slices repeat more of their pieces.
SLICE_BYTES = 8 << 20


def may_be_cut(spec: dict) -> bool:
    """Whether a tokenizer file takes bytes as they are, by the usual pattern, and alters no ids."""
    split, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = ("normalizer", "truncation", "padding")
    no_marks = ("continuing_subword_prefix", "end_of_word_suffix", "dropout")
    return (
        split.get("type") == "ByteLevel" and split.get("use_regex", True)
        and not split.get("add_prefix_space", True) and not any(spec.get(p) for p in plain)
        and model.get("type") == "BPE" and not any(model.get(m) for m in no_marks)
    )


class ByteEncoder:
    """Encodes texts with a byte-level tokenizer of the tokenizers library."""

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        spec = json.loads(tokenizer_json)
        self.cuts = may_be_cut(spec)
        self.added = [t["content"] for t in spec["added_tokens"]]
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.widths = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, number in spec["model"]["vocab"].items():
            self.widths[number] = len(token)  # one character per byte
        self.cache = PieceCache(self._encode_pieces, CACHED_PIECES)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Encodes many pieces as one text and cuts its ids where the pieces' bytes end.

        A piece without a leading space or line feed starts a text of its own.
        """
        opens = [i for i, p in enumerate(pieces) if p[:1] not in " \n"]
        first = set(opens)
        order = [*opens, *(i for i in range(len(pieces)) if i not in first)]
        texts = [pieces[i] for i in opens]
        rest = order[len(opens):]
        texts += [
            "".join(pieces[i] for i in rest[at:at + JOINED_PIECES])
            for at in range(0, len(rest), JOINED_PIECES)
        ]
        found = [np.array(ids, np.uint32) for ids in self._whole(texts)]
        flat = np.concatenate([np.zeros(0, np.uint32), *found])
        sizes = pc.binary_length(pa.array([pieces[i] for i in order], pa.string())).to_numpy()
        cuts = np.searchsorted(np.cumsum(self.widths[flat]), np.cumsum(sizes), side="right")
        lengths = np.diff(np.concatenate([[0], cuts]))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        starts = np.cumsum(lengths) - lengths
        return gather_runs(flat, starts[back], lengths[back]), lengths[back]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and how many each text has."""
        if not self.cuts:
            found = [np.array(ids, np.uint32) for ids in self._whole(texts.to_pylist())]
            flat = np.concatenate([np.zeros(0, np.uint32), *found])
            return flat, np.fromiter(map(len, found), np.int64, len(found))
        whole = pc.match_substring_regex(texts, WHOLE_ONLY)
        for token in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, token))
        whole = whole.to_numpy(zero_copy_only=False)
        marked = pc.if_else(pa.array(whole), "", texts)
        marked = pc.replace_substring_regex(marked, LETTER_THEN_MARK, rf"\1{MARK}\2")
        for blank in " \n":
            marked = pc.replace_substring(marked, blank, MARK + blank)
        ids, distinct, offsets = encoded_lists(pc.split_pattern(marked, MARK))
        starts, lengths = self.cache.runs(distinct.to_numpy(zero_copy_only=False).tolist())
        counts = lengths[ids]
        flat = gather_runs(self.cache.ids, starts[ids], counts)
        totals = np.diff(np.concatenate([[0], np.cumsum(counts)])[offsets])
        if not whole.any():
            return flat, totals
        parts = np.split(flat, np.cumsum(totals)[:-1])
        at = np.flatnonzero(whole)
        for row, found in zip(at, self._whole(texts.take(pa.array(at)).to_pylist())):
            parts[row] = np.array(found, np.uint32)
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))


@lru_cache(maxsize=1)
def byte_encoder(tokenizer_json: str) -> ByteEncoder:
    return ByteEncoder(tokenizer_json)


def binary_array(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Bytes cut into values of these lengths."""
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    if offsets[-1] >= 1 << 31:
        raise ValueError("a batch of more than 2 GB; lower the slice size")
    buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))]
    return pa.Array.from_buffers(pa.binary(), len(lengths), buffers)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column in a row, and the length of each value."""
    column = pc.fill_null(column, b"")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:][:len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0]:offsets[-1]], np.diff(offsets).astype(np.int64)


def with_end(flat: np.ndarray, lengths: np.ndarray, end_id: int) -> np.ndarray:
    """The ids with ``end_id`` after each row."""
    out = np.full(len(flat) + len(lengths), end_id, np.uint32)
    body = np.ones(len(out), bool)
    body[np.cumsum(lengths + 1) - 1] = False
    out[body] = flat
    return out


# ------------------------------------------------------------------------------ coding


def encode_ranks(ranks: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes and data bytes of rows of ranks, each with its bytes per row."""
    values = ranks.astype(np.uint32)
    widths = 1 + (values >= 1 << 8).astype(np.int64) + (values >= 1 << 16) + (values >= 1 << 24)
    ends = np.cumsum(widths)
    starts = ends - widths
    data = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    for byte in range(4):
        has = widths > byte
        data[starts[has] + byte] = (values[has] >> np.uint32(8 * byte)) & np.uint32(255)
    quads = (lengths + 3) // 4
    first_slot = 4 * (np.cumsum(quads) - quads)
    first_value = np.cumsum(lengths) - lengths
    slots = np.arange(len(values)) + np.repeat(first_slot - first_value, lengths)
    codes = np.zeros(4 * quads.sum(), np.uint8)
    codes[slots] = widths - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    bytes_before = np.concatenate([[0], ends])
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    return control, quads, data, np.diff(bytes_before[bounds])


#: The four byte lengths that each control byte names.
WIDTHS = 1 + ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3)


def decode_ranks(control: np.ndarray, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ranks of rows of these lengths, by table lookup of their control bytes."""
    quads = (lengths + 3) // 4
    first_slot = 4 * (np.cumsum(quads) - quads)
    first_value = np.cumsum(lengths) - lengths
    slots = np.arange(lengths.sum()) + np.repeat(first_slot - first_value, lengths)
    widths = WIDTHS[control].reshape(-1)[slots]
    starts = np.cumsum(widths) - widths
    values = data[starts].astype(np.uint32)
    for byte in range(1, 4):
        has = np.flatnonzero(widths > byte)
        values[has] |= data[starts[has] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return values


# ------------------------------------------------------------------------------ writing


def encoded(docs: DataFrame, tokenizer_json: str, end_id: int = END_ID) -> DataFrame:
    """Rows (doc_id, first, n_tokens, ids) in ascending doc_id order, ranges over partitions.

    ``ids`` are little-endian, two bytes each for vocabularies of up to 65,536, else four;
    ``first`` counts the ids before a row in its partition. Rows that share an id are ordered by
    a hash of their text.
    """
    kind = np.uint16 if _vocab_size(tokenizer_json) <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in text_slices(batches, max_bytes=SLICE_BYTES):
            flat, lengths = byte_encoder(tokenizer_json).encode(column_texts(batch))
            flat, lengths = with_end(flat, lengths, end_id), lengths + 1
            ends = before + np.cumsum(lengths)
            before = int(ends[-1])
            ids = binary_array(flat.astype(kind).view(np.uint8), lengths * kind().itemsize)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ends - lengths), pa.array(lengths), ids],
                names=["doc_id", "first", "n_tokens", "ids"],
            )

    keyed = docs.select(
        F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie")
    )
    return (
        keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
        .mapInArrow(run, "doc_id long, first long, n_tokens long, ids binary")
    )


def _vocab_size(tokenizer_json: str) -> int:
    spec = json.loads(tokenizer_json)
    added = [t["id"] for t in spec["added_tokens"]]
    return 1 + max([*spec["model"]["vocab"].values(), *added])


def token_ranks(ids: DataFrame, vocab_size: int) -> np.ndarray:
    """Rank of each token id by its count in the rows of ``encoded``, ties by id."""
    kind = np.uint16 if vocab_size <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(vocab_size, np.int64)
        for batch in batches:
            counts += np.bincount(flat_bytes(batch.column("ids"))[0].view(kind), minlength=vocab_size)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found), pa.array(counts[found])], names=["token", "n"]
        )

    rows = ids.select("ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n"))
    counts = np.zeros(vocab_size, np.int64)
    for token, n in rows.collect():  # a row per token of the vocabulary at most
        counts[token] = n
    ranks = np.empty(vocab_size, np.uint32)
    ranks[np.argsort(-counts, kind="stable")] = np.arange(vocab_size, dtype=np.uint32)
    return ranks


def write_token_files(
    docs: DataFrame, tokenizer_json: str, path: str, end_id: int = END_ID
) -> None:
    """Encodes every text and writes the files under ``path``.

    A null text counts as empty; it and the empty text are the end id alone. Repeated ids are
    rows of their own; null ids come first. No documents give no rows. Other columns are
    not looked at.
    """
    spark = docs.sparkSession
    vocab_size = max(_vocab_size(tokenizer_json), end_id + 1)
    kind = np.uint16 if _vocab_size(tokenizer_json) <= 1 << 16 else np.uint32
    table = stored(
        encoded(docs, tokenizer_json, end_id).withColumn("shard", F.spark_partition_id()), "token-ids"
    )
    ranks = token_ranks(table, vocab_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "ids"):
            flat, sizes = flat_bytes(batch.column("ids"))
            lengths = sizes // kind().itemsize
            control, n_control, data, n_data = encode_ranks(ranks[flat.view(kind)], lengths)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("first"), batch.column("n_tokens"),
                    binary_array(control, n_control), binary_array(data, n_data),
                    batch.column("shard"),
                ],
                names=["doc_id", "first", "n_tokens", "control", "data", "shard"],
            )

    (
        table.mapInArrow(
            run, "doc_id long, first long, n_tokens long, control binary, data binary, shard int"
        )
        .sortWithinPartitions("shard", "first")
        .write.partitionBy("shard").option("compression", "zstd").parquet(f"{path}/files")
    )
    order = np.empty(vocab_size, np.int64)
    order[ranks] = np.arange(vocab_size)
    spark.createDataFrame(
        [(int(r), int(t)) for r, t in enumerate(order)], "rank int, token int"
    ).coalesce(1).write.parquet(f"{path}/ranks")


# ------------------------------------------------------------------------------ reading


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids): ids as little-endian unsigned 32-bit integers.

    ``start`` counts the ids of all rows before, over all shards in order.
    """
    files = spark.read.schema(
        "doc_id long, first long, n_tokens long, control binary, data binary, shard int"
    ).parquet(f"{path}/files")
    totals = (
        files.groupBy("shard").agg(F.max(F.col("first") + F.col("n_tokens")).alias("n")).collect()
    )  # one row per shard
    sizes = np.zeros(max([-1, *(r.shard for r in totals)]) + 2, np.int64)
    for r in totals:
        sizes[r.shard + 1] = r.n
    bases = np.cumsum(sizes)
    named = spark.read.parquet(f"{path}/ranks").collect()
    tokens = np.zeros(len(named), np.uint32)
    for rank, token in named:
        tokens[rank] = token

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "data"):
            lengths = batch.column("n_tokens").to_numpy()
            control, data = (flat_bytes(batch.column(c))[0] for c in ("control", "data"))
            ids = tokens[decode_ranks(control, data, lengths)]
            starts = bases[batch.column("shard").to_numpy()] + batch.column("first").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(starts), batch.column("n_tokens"),
                    binary_array(ids.astype("<u4").view(np.uint8), 4 * lengths),
                ],
                names=["doc_id", "start", "n_tokens", "ids"],
            )

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def token_file_digests(docs: DataFrame, tokenizer_json: str) -> DataFrame:
    """Writes token files and returns what is read back: (doc_id, start, n_tokens, ids_crc32)."""
    spark = docs.sparkSession
    path = fresh_path(spark, "token-files")
    write_token_files(docs, tokenizer_json, path)
    return read_token_files(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def tokenizer_text(name_or_path: str) -> str:
    """A tokenizer file as text, read on the driver and sent to the tasks; a vocabulary in size."""
    with open(name_or_path, encoding="utf-8") as file:
        return file.read()



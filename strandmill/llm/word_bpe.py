"""Word-end BPE: encoding by merge rounds over flat arrays, and decoding.

Symbols of many words lie in one array. In each round every word's lowest-rank pair is found
by binary search over the sorted pair keys, and all its occurrences are merged; words without
a pair to merge leave the array. Long words take as many rounds as the merges they hold: they are
linked in flat arrays, a round merges one rank in all of them, and only pairs beside a merge are
looked up again. Ids equal those of the tokenizers library, which is not used.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.pieces import PieceCache
from strandmill.llm.text_arrays import column_texts, encoded_lists, gather_runs, text_slices

#: White space other than ASCII's, which parts words too.
OTHER_SPACE = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Below this character all versions of Unicode since 6.0 agree.
LATER = "\u0530"
#: Letters and digits of Unicode 16 that Python's tables (15.1) lack.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
    (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B),
    (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1),
    (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D),
    (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_DIGITS = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139),
    (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
)
#: Capitals that Python's tables lack, as ranges with the step to the small letter.
NEW_CAPITALS = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1),
    (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC),
    (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
)
LOWER_NEW = {c: c + step for first, last, step in NEW_CAPITALS for c in range(first, last + 1)}
#: Words with more symbols are merged rank by rank.
LONG_WORD = 64
DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def character_class(kind: str, added: tuple[tuple[int, int], ...]) -> str:
    """The letters (``L``) or digits (``N``) of Unicode 16, as ranges for a set in a pattern."""
    has = np.fromiter(
        (unicodedata.category(chr(c))[0] == kind for c in range(0x110000)), bool, 0x110000
    )
    for first, last in added:
        has[first:last + 1] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[False], has, [False]]).astype(np.int8)))
    return "".join(
        f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())
    )


class WordBpe:
    """A vocabulary, its merges and its pre-tokenizer, as read from a tokenizer file."""

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.end = model["end_of_word_suffix"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = f"{pattern}|\n"
        self.words = regex.compile(self.pattern).findall
        self.any_words = None
        size = 1 + max([*vocab.values(), *self.added.values()])
        self.size = np.int64(size)
        self.tokens = [""] * size
        for token, number in {**vocab, **self.added}.items():
            self.tokens[number] = token
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + self.end] for s in symbols], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.pair_of_rank = keys
        # Ranks whose symbol takes part in a merge of lower rank; trained files have none.
        used = np.full(size, len(pairs))
        np.minimum.at(used, np.concatenate([keys // size, keys % size]), np.tile(np.arange(len(pairs)), 2))
        self.early = frozenset(np.flatnonzero(used[made] < np.arange(len(pairs))).tolist())
        self.word_cache = PieceCache(self.encode_words, 50_000)
        self.piece_cache = PieceCache(self._encode_pieces, 100_000)

    # ------------------------------------------------------------------ merging

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or the number of merges where there is none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.keys))

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these words in a row, and how many each has."""
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        lasts = np.cumsum(sizes) - 1
        symbols[lasts] = self.final[data[lasts]]
        rows = np.repeat(np.arange(len(words)), sizes)
        long = (sizes > LONG_WORD)[rows]
        parts = [self._merge_rounds(symbols[~long], rows[~long])]
        if long.any():
            parts.append(self._merge_ranks(symbols[long], rows[long]))
        symbols, rows = map(np.concatenate, zip(*parts))
        order = np.argsort(rows, kind="stable")
        return symbols[order].astype(np.uint32), np.bincount(rows, minlength=len(words))

    def _merge_ranks(self, symbols: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges rank by rank, lowest first: each round makes one merge in all words.

        Symbols form linked lists, one per word; places wait under the rank of their pair, and
        those whose pair has changed since are passed over.
        """
        symbols, n = symbols.copy(), len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        border = np.flatnonzero(rows[1:] != rows[:-1])
        after[border], before[border + 1], after[n - 1] = -1, -1, -1
        alive = np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def wait(places: np.ndarray) -> None:
            places = places[after[places] >= 0]
            ranks = self._pair_ranks(symbols[places], symbols[after[places]])
            found = ranks < len(self.keys)
            places, ranks = places[found], ranks[found]
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            firsts = np.flatnonzero(np.diff(ranks, prepend=-1)).tolist()
            for start, stop in zip(firsts, [*firsts[1:], len(ranks)]):
                rank = int(ranks[start])
                if rank not in waiting:
                    waiting[rank] = []
                    heapq.heappush(queue, rank)
                waiting[rank].append(places[start:stop])

        wait(np.arange(n))
        while queue:
            rank = heapq.heappop(queue)
            places = np.unique(np.concatenate(waiting.pop(rank)))
            places = places[alive[places] & (after[places] >= 0)]
            places = places[symbols[places] * self.size + symbols[after[places]] == self.pair_of_rank[rank]]
            if not len(places):
                continue
            if rank in self.early:
                # What the first place of a word makes may come before its other places.
                first = np.unique(rows[places], return_index=True)[1]
                others = np.delete(places, first)
                places = places[first]
            else:
                # Of places that share a symbol, every other one from the left is merged.
                shared = np.concatenate([[False], after[places[:-1]] == places[1:]])
                at = np.arange(len(places))
                start = np.maximum.accumulate(np.where(shared, 0, at))
                others, places = places[:0], places[(at - start) % 2 == 0]
            gone = after[places]
            symbols[places] = self.made[rank]
            alive[gone] = False
            after[places] = after[gone]
            linked = places[after[places] >= 0]
            before[after[linked]] = linked
            left = before[places]
            wait(np.unique(np.concatenate([left[left >= 0], places, others])))
        return symbols[alive], rows[alive]

    def _merge_rounds(self, symbols: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges in rounds: each makes the lowest-rank merge of every word."""
        none = len(self.keys)
        done_rows, done_symbols = [], []
        while len(symbols):
            ranks = np.full(len(symbols), none)
            same = rows[1:] == rows[:-1]
            ranks[:-1][same] = self._pair_ranks(symbols[:-1][same], symbols[1:][same])
            firsts = np.flatnonzero(np.concatenate([[True], ~same]))
            lowest = np.minimum.reduceat(ranks, firsts)
            counts = np.diff(np.concatenate([firsts, [len(symbols)]]))
            lowest = np.repeat(lowest, counts)
            over = lowest == none
            done_rows.append(rows[over])
            done_symbols.append(symbols[over])
            merge = (ranks == lowest) & ~over
            # Of pairs that share a symbol, every other one from the left is merged.
            runs = np.flatnonzero(merge & ~np.concatenate([[False], merge[:-1]]))
            at = np.flatnonzero(merge)
            start = runs[np.searchsorted(runs, at, side="right") - 1]
            merged = at[(at - start) % 2 == 0]
            symbols = symbols.copy()
            symbols[merged] = self.made[ranks[merged]]
            keep = ~over
            keep[merged + 1] = False
            symbols, rows = symbols[keep], rows[keep]
        rows, symbols = map(np.concatenate, (done_rows or [rows], done_symbols or [symbols]))
        return symbols, rows

    # ------------------------------------------------------------------ texts

    def _normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        # Each character by itself: no final form of sigma.
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        return text if max(text, default="") < LATER else text.translate(LOWER_NEW)

    def _words_of(self, text: str) -> list[str]:
        if max(text, default="") < LATER:
            return self.words(text)
        if self.any_words is None:
            pattern = self.pattern.replace(r"\p{L}", character_class("L", NEW_LETTERS))
            pattern = pattern.replace(r"\p{N}", character_class("N", NEW_DIGITS))
            self.any_words = regex.compile(pattern).findall
        return self.any_words(text)

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces without white space; an added token's text is that token."""
        whole = {i: self.added[p] for i, p in enumerate(pieces) if p in self.added}
        text = self._normal("\n".join("" if i in whole else p for i, p in enumerate(pieces)))
        encoded = pa.array(self._words_of(text), pa.string()).dictionary_encode()
        numbers, distinct = encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary.to_pylist()
        breaks = numbers == (distinct.index("\n") if "\n" in distinct else -1)
        owner = np.cumsum(breaks)[~breaks]
        starts, lengths = np.zeros((2, len(distinct)), np.int64)
        real = [i for i, w in enumerate(distinct) if w != "\n"]
        starts[real], lengths[real] = self.word_cache.runs([distinct[i] for i in real])
        numbers = numbers[~breaks]
        flat = gather_runs(self.word_cache.ids, starts[numbers], lengths[numbers])
        counts = np.bincount(owner, weights=lengths[numbers], minlength=len(pieces)).astype(np.int64)
        if whole:
            at = np.array(list(whole))
            flat = np.insert(flat, (np.cumsum(counts) - counts)[at], list(whole.values()))
            counts[at] = 1
        return flat, counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and how many each text has."""
        if pc.any(pc.match_substring_regex(texts, OTHER_SPACE)).as_py():
            texts = pc.replace_substring_regex(texts, OTHER_SPACE, " ")
        for token in self.added:
            texts = pc.replace_substring(texts, token, f" {token} ")
        ids, distinct, offsets = encoded_lists(pc.ascii_split_whitespace(texts))
        starts, lengths = self.piece_cache.runs(distinct.to_pylist())
        counts = lengths[ids]
        flat = gather_runs(self.piece_cache.ids, starts[ids], counts)
        return flat, np.diff(np.concatenate([[0], np.cumsum(counts)])[offsets])

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the file, tokens are joined by spaces."""
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=1)
def word_bpe(tokenizer_json: str) -> WordBpe:
    return WordBpe(tokenizer_json)


def encode_texts(docs: DataFrame, tokenizer_json: str) -> DataFrame:
    """Rows (doc_id, ids), one per document.

    A null text counts as empty; an empty text has no ids. Null and repeated ids are rows like
    any other. Other columns are not looked at.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            flat, lengths = word_bpe(tokenizer_json).encode(column_texts(batch))
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            ids = pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    return _keyed(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(rows: DataFrame, tokenizer_json: str) -> DataFrame:
    """Rows (doc_id, text) of rows (doc_id, ids); null ids count as none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = word_bpe(tokenizer_json).decode
        for batch in batches:
            texts = [decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"]
            )

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_digests(docs: DataFrame, tokenizer_json: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256) of the ids and of their decoding.

    Nulls, empty texts and repeated ids are as in ``encode_texts``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer_json)
        for batch in text_slices(batches):
            flat, lengths = bpe.encode(column_texts(batch))
            of_ids, of_texts = [], []
            for ids in np.split(flat.astype("<u4"), np.cumsum(lengths)[:-1]):
                of_ids.append(hashlib.sha256(ids.tobytes()).hexdigest())
                of_texts.append(hashlib.sha256(bpe.decode(ids.tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, (lengths, of_ids, of_texts))],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _keyed(docs).mapInArrow(run, DIGEST_SCHEMA)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text")

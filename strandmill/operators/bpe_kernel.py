"""Applying BPE merges to a batch of texts; runs inside tasks.

All texts of a batch are laid end to end in flat arrays that form one linked list of symbols.
Merges are applied in rank order, each to all its places in the batch at once.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import defaultdict
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class EncoderTables:
    """What a task needs of a vocabulary; bounded by the vocabulary size."""

    code_points: np.ndarray  # sorted code points of single-character tokens
    code_ids: np.ndarray
    specials: tuple[tuple[str, int], ...]  # longest first
    unk_id: int
    n_tokens: int
    pair_keys: np.ndarray  # sorted left * n_tokens + right
    pair_ranks: np.ndarray
    left: np.ndarray  # by rank
    right: np.ndarray
    product: np.ndarray
    early: frozenset[int]  # ranks whose product takes part in a merge of lower rank


def build_tables(tokens: list[str], merges: list[tuple[int, int, int]],
                 specials: list[tuple[str, int]], unk_id: int) -> EncoderTables:
    special_names = {name for name, _ in specials}
    chars = sorted(
        (ord(t), i) for i, t in enumerate(tokens) if len(t) == 1 and t not in special_names
    )
    n = len(tokens)
    table = np.array(merges, dtype=np.int64).reshape(-1, 3)
    keys = table[:, 0] * n + table[:, 1]
    # A pair listed twice counts with its lowest rank.
    unique, first = np.unique(keys, return_index=True)
    uses: dict[int, int] = {}
    for rank, (a, b, _) in enumerate(merges):
        uses.setdefault(a, rank)
        uses.setdefault(b, rank)
    early = frozenset(r for r, (_, _, new) in enumerate(merges) if uses.get(new, r) < r)
    return EncoderTables(
        np.array([c for c, _ in chars], dtype=np.int64),
        np.array([i for _, i in chars], dtype=np.int64),
        tuple(sorted(specials, key=lambda s: -len(s[0]))), unk_id, n,
        unique, first.astype(np.int64), table[:, 0], table[:, 1], table[:, 2], early,
    )


def _symbols(texts: list[str], t: EncoderTables):
    """Flat symbol ids with start, end (within the text) and text number."""
    sizes = np.array([len(x) for x in texts], dtype=np.int64)
    begin = np.concatenate(([0], np.cumsum(sizes)))
    whole = "".join(texts)
    codes = np.frombuffer(whole.encode("utf-32-le"), dtype="<u4").astype(np.int64)
    ids = np.full(len(codes), t.unk_id, dtype=np.int64)
    if len(t.code_points) and len(codes):
        slot = np.minimum(np.searchsorted(t.code_points, codes), len(t.code_points) - 1)
        known = t.code_points[slot] == codes
        ids[known] = t.code_ids[slot[known]]
    text_no = np.repeat(np.arange(len(texts)), sizes)
    stop = np.arange(1, len(codes) + 1)
    keep = np.ones(len(codes), dtype=bool)
    initials = np.array(sorted({ord(s[0]) for s, _ in t.specials}), dtype=np.int64)
    done = 0
    for at in np.flatnonzero(np.isin(codes, initials)).tolist():
        if at < done:
            continue
        for name, special_id in t.specials:
            if whole.startswith(name, at) and at + len(name) <= begin[text_no[at] + 1]:
                done = at + len(name)
                ids[at], stop[at] = special_id, done
                keep[at + 1:done] = False
                break
    where = np.flatnonzero(keep)
    base = begin[text_no[where]]
    return ids[where], where - base, stop[where] - base, text_no[where]


def _ranks(left: np.ndarray, right: np.ndarray, t: EncoderTables) -> np.ndarray:
    """Rank of each pair, -1 where there is none."""
    if not len(t.pair_keys):
        return np.full(len(left), -1, dtype=np.int64)
    keys = left * t.n_tokens + right
    slot = np.minimum(np.searchsorted(t.pair_keys, keys), len(t.pair_keys) - 1)
    return np.where(t.pair_keys[slot] == keys, t.pair_ranks[slot], -1)


def _changes(values: np.ndarray) -> np.ndarray:
    """Where a sorted array differs from the element before."""
    return np.concatenate(([True], values[1:] != values[:-1]))


def _every_second(places: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Of places that overlap in a run (``aaaa``), every second one from the left."""
    linked = np.concatenate(([False], nxt[places[:-1]] == places[1:]))
    index = np.arange(len(places))
    run_start = np.maximum.accumulate(np.where(linked, 0, index))
    return places[(index - run_start) % 2 == 0]


@dataclass(frozen=True)
class Dropout:
    """Which places of a merge are passed over: a hash of seed, text, place, merge and round decides."""

    rate: float
    keys: np.ndarray  # one per text, unsigned 64 bits

    def passed(self, text_no: np.ndarray, start: np.ndarray, rank: int, round_no: int) -> np.ndarray:
        salt = np.uint64((rank << 24 ^ round_no) & 0xFFFFFFFFFFFFFFFF)
        drawn = _mixed(_mixed(self.keys[text_no] ^ start.astype(np.uint64)) ^ salt)
        return (drawn >> np.uint64(11)) * 2.0 ** -53 < self.rate


def _mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit integers in which every bit depends on all."""
    x = (x + np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_keys(seed: int, keys: list[str]) -> np.ndarray:
    """A 64-bit number per row key."""
    digests = [hashlib.blake2b(f"{seed}|dropout|{k}".encode(), digest_size=8).digest() for k in keys]
    return np.frombuffer(b"".join(digests), dtype="<u8")


def encode(texts: list[str], t: EncoderTables, dropout: Dropout | None = None):
    """Token ids, starts and ends of all texts as flat arrays, plus token counts per text.

    With dropout, merges are made in rounds. In a round each place of a merge is passed over with
    the given rate, and is offered again in the next one; a text is done with the first round
    that merges nothing in it. Draws do not depend on the other texts of the batch.
    """
    sym, start, stop, text_no = _symbols(texts, t)
    n = len(sym)
    nxt = np.arange(1, n + 1)
    prv = np.arange(-1, n - 1)
    if n:
        last = np.concatenate((text_no[1:] != text_no[:-1], [True]))
        nxt[last] = -1
        prv[np.concatenate(([True], last[:-1]))] = -1
    alive = np.ones(n, dtype=bool)
    waiting: dict[int, list[np.ndarray]] = defaultdict(list)
    queue: list[int] = []
    round_no = 0
    merged = np.zeros(len(texts), dtype=bool)

    def push(places: np.ndarray) -> None:
        places = places[nxt[places] >= 0]
        rank = _ranks(sym[places], sym[nxt[places]], t)
        places, rank = places[rank >= 0], rank[rank >= 0]
        if not len(places):
            return
        order = np.argsort(rank, kind="stable")
        places, rank = places[order], rank[order]
        first = np.flatnonzero(_changes(rank))
        bounds = [*first.tolist(), len(rank)]
        for r, begin, end in zip(rank[first].tolist(), bounds, bounds[1:]):
            if r not in waiting:
                heapq.heappush(queue, r)
            waiting[r].append(places[begin:end])

    def merge_all() -> None:
        while queue:
            rank = heapq.heappop(queue)
            places = np.sort(np.concatenate(waiting.pop(rank)))
            places = places[_changes(places)]
            a, b = t.left[rank], t.right[rank]
            places = places[alive[places] & (nxt[places] >= 0)]
            places = places[(sym[places] == a) & (sym[nxt[places]] == b)]
            if dropout is not None:
                places = places[~dropout.passed(text_no[places], start[places], rank, round_no)]
            if not len(places):
                continue
            if a == b:
                places = _every_second(places, nxt)
            if rank in t.early:
                # The product may enable an earlier merge, which then comes first in its text.
                head = np.flatnonzero(_changes(text_no[places]))
                rest = np.delete(places, head)
                places = places[head]
                if len(rest):
                    heapq.heappush(queue, rank)
                    waiting[rank].append(rest)
            right = nxt[places]
            after = nxt[right]
            sym[places] = t.product[rank]
            stop[places] = stop[right]
            alive[right] = False
            nxt[places] = after
            has_after = after >= 0
            prv[after[has_after]] = places[has_after]
            merged[text_no[places]] = True
            before = prv[places]
            push(np.concatenate((before[before >= 0], places)))

    push(np.arange(n))
    merge_all()
    while dropout is not None and merged.any():
        places = np.flatnonzero(alive)
        places = places[merged[text_no[places]]]
        merged[:] = False
        round_no += 1
        push(places)
        merge_all()
    counts = np.bincount(text_no[alive], minlength=len(texts))
    return sym[alive], start[alive], stop[alive], counts


# ---------------------------------------------------------------- counting pairs while training


def replace_all(texts: list[str], pairs: list[tuple[str, str]]) -> list[str]:
    """Apply replacements in order; NUL, which no coded text holds, keeps texts apart."""
    if not texts or not pairs:
        return texts
    whole = "\0".join(texts)
    for pair, product in pairs:
        whole = whole.replace(pair, product)
    return whole.split("\0")


def weighted_pairs(texts: list[str], weight: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Neighbouring characters of all texts with the summed weight of the texts they are in."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    inside = row[:-1] == row[1:]
    if not inside.any():
        return [], np.zeros(0, dtype=np.int64)
    keys = (codes[:-1] << 32 | codes[1:])[inside]
    of_text = row[:-1][inside]
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(_changes(keys))
    sums = np.add.reduceat(weight[of_text[order]].astype(np.int64), first)
    pairs = [chr(k >> 32) + chr(k & 0xFFFFFFFF) for k in keys[first].tolist()]
    return pairs, sums

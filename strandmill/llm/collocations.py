"""Collocations from a weighted de Bruijn graph of words.

Nodes are runs of two words, edges runs of three that lead from their first two words to their
last two; an edge weighs as much as it occurs. Only edges, and the shorter runs at ends of pieces,
are counted in texts, and moved once. A node's count is the flow out of it, plus what ends in it; a word's count
is the flow of the nodes it begins, plus what ends in it.

A node whose whole flow comes in by one edge and leaves by one edge is inner: nothing begins,
ends or branches there. Edges are joined through inner nodes into paths, one row each, in which
all runs have the path's weight; so only the ends of paths are looked up. The graph has no circle
of inner nodes, as a piece that enters one could not end. Paths lighter than the least count hold
no candidate and are not built.

A null text is an empty one, a null language is ``und``. Ids are not read: repeated rows count
each. Texts without words and empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.llm.store import stored
from strandmill.llm.text_arrays import (
    STEP, give_back, hash_strings, mix, strings, text_buffer, text_slices,
)

MIN_COUNT, TOP, COVERED = 10, 2000, 50
UNKNOWN = "und"
SCALE = 1_000_000
#: Slices of a language in which the first rows are chosen before they meet.
RANK_SLICES = 64
#: Places that nodes are dealt to, and parts of them for each shuffle partition.
PLACES, PARTS = 1 << 30, 4
#: Edges added up at once at least, and what stands for a line feed in a language.
ADDED_ROWS, ESCAPED = 1 << 19, "\x00n"
#: Nodes whose edges are dealt to all places, and documents that they are looked for in.
HOT_NODES, SAMPLED_DOCS = 1024, 10_000

BLANK, BREAK = 1, 2
_KINDS = np.zeros(256, np.uint8)
_KINDS[list(b" \t")] = BLANK
_KINDS[list(b".,;:!?\n\x0b\x0c\r")] = BREAK


# ------------------------------------------------------------------- counting in texts

def piece_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words in lower case (A-Z), the row of each, and whether it is the last of its piece."""
    data, offsets = text_buffer(texts)
    data = np.where(data - np.uint8(65) < 26, data | 32, data)
    kinds = _KINDS[data]
    word = kinds == 0
    first = word.copy()
    first[1:] &= ~word[:-1]
    opening = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[opening] = word[opening]
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(np.cumsum(word)[starts] - 1, word.sum()))
    rows = np.searchsorted(offsets, starts, side="right") - 1
    breaks = np.cumsum(kinds == BREAK)[starts]
    last = np.ones(len(starts), bool)
    last[:-1] = (rows[1:] != rows[:-1]) | (breaks[1:] != breaks[:-1])
    return strings(data[word], np.concatenate([[0], np.cumsum(sizes)])), rows, last


#: Columns of counted edges: where the node lies; the node's words, a tab (in no word) and the
#: language; the word that the edge adds, or none where a piece ends.
EDGES = "place int, node string, rest string, n long"


def edge_counts(texts: pa.Array, langs: pa.Array, hot: Sequence[str] = ()) -> pa.Table:
    """Rows of ``EDGES``: the run of three words that begins at each word, or what is left of its
    piece. All edges that leave a node have its place, those that leave a hot one have any."""
    words, rows, last = piece_words(texts)
    coded, spoken = words.dictionary_encode(), pc.fill_null(langs, UNKNOWN).dictionary_encode()
    names, tongues = coded.dictionary, spoken.dictionary.cast(pa.large_string())
    if not len(words):
        return pa.table([pa.array([], t) for t in (pa.int32(), pa.string(), pa.string(), pa.int64())],
                        ["place", "node", "rest", "n"])
    size = len(names)
    both = spoken.indices.to_numpy()[rows].astype(np.int64) * size + coded.indices.to_numpy()
    known, own = np.unique(both, return_inverse=True)
    # Words of a language from 1 on; 0 where the piece has ended.
    one = own.astype(np.int64) + 1
    two, three = np.zeros((2, len(one)), np.int64)
    two[:-1] = np.where(last[:-1], 0, one[1:])
    three[:-1] = np.where(last[:-1], 0, two[1:])
    base = len(known) + 1
    nodes_at, node = np.unique(one * base + two, return_inverse=True)
    edge, counts = np.unique(node.astype(np.int64) * base + three, return_counts=True)
    head = nodes_at[edge // base]
    one, two, three = head // base, head % base, edge % base

    def word(code: np.ndarray) -> pa.Array:
        return names.take(pa.array(known[np.maximum(code, 1) - 1] % size, mask=code == 0))

    def joined(sign: str, *parts: pa.Array) -> pa.Array:
        return pc.binary_join_element_wise(*parts, pa.scalar(sign, pa.large_string()), null_handling="skip")

    # Of words alone, so that all tasks agree.
    hashes = np.concatenate([np.zeros(1, np.uint64), (
        mix(hash_strings(tongues))[known // size] ^ hash_strings(names)[known % size])])
    place = mix(hashes[one] * STEP + hashes[two])
    runs = joined("\t", joined(" ", word(one), word(two)), tongues.take(pa.array(known[one - 1] // size)))
    if hot:
        dealt = pc.is_in(runs, pa.array(hot, pa.large_string())).to_numpy(zero_copy_only=False)
        place[dealt] = mix(place[dealt] ^ hashes[three[dealt]])
    return pa.table({
        "place": (place % np.uint64(PLACES)).astype(np.int32), "node": runs.cast(pa.string()),
        "rest": word(three).cast(pa.string()), "n": counts,
    })


def _joined_lines(column: pa.ChunkedArray) -> pa.Buffer:
    values = column.combine_chunks()
    whole = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    return pc.binary_join(whole, "\n")[0].as_buffer()


def _pack(edges: pa.Table) -> bytes:
    """Edges as one compressed value: no word or language has a line feed but escaped ones."""
    nodes, rests = (_joined_lines(edges[c]) for c in ("node", "rest"))
    counts = np.ascontiguousarray(edges["n"].to_numpy().astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    sizes = np.array([nodes.size, rests.size, len(counts)], "<i8").tobytes()
    return sizes + pa.compress(b"".join([nodes, rests, counts]), "zstd", asbytes=True)


def _unpack(packed: pa.Buffer) -> pa.Table:
    a, b, c = np.frombuffer(packed, "<i8", 3).tolist()
    raw = pa.decompress(packed.slice(24), a + b + c, "zstd")
    lines = [
        pc.split_pattern(pa.Array.from_buffers(
            pa.large_string(), 1, [None, pa.py_buffer(np.array([0, size], np.int64)), raw.slice(at, size)]), "\n").flatten()
        for at, size in ((0, a), (a, b))
    ]
    counts = np.ascontiguousarray(np.frombuffer(raw.slice(a + b), np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return pa.table({"node": lines[0], "rest": lines[1], "n": counts.astype(np.int64)})


def _packed_edges(hot: Sequence[str], parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            langs = pc.replace_substring(pc.fill_null(batch.column("lang"), UNKNOWN), "\n", ESCAPED)
            table = edge_counts(batch.column("text"), langs, hot)
            if not table.num_rows:
                continue
            part = table["place"].to_numpy() % parts
            order = np.argsort(part, kind="stable")
            firsts = np.flatnonzero(np.diff(part[order], prepend=-1))
            table = table.set_column(2, "rest", pc.fill_null(table["rest"], "")).take(pa.array(order))
            ends = np.append(firsts[1:], len(order))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[order[firsts]].astype(np.int32)),
                 pa.array([_pack(table.slice(x, y - x)) for x, y in zip(firsts.tolist(), ends.tolist())], pa.binary())],
                ["part", "edges"],
            )

    return run


def _add(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by(["node", "rest"]).aggregate([("n", "sum")]).rename_columns(["node", "rest", "n"])


def _part_flows(edges: pa.Table, hot: Sequence[str], min_count: int) -> Iterator[pa.RecordBatch]:
    """What all edges of a part say of runs of three, two and one words: (lang, gram, n)."""
    def cut(keys: pa.ChunkedArray, tail: pa.ChunkedArray | None, n: pa.ChunkedArray) -> Iterator[pa.RecordBatch]:
        words, lang = (pc.replace_substring_regex(keys, p, "") for p in ("\t(?s:.*)$", "^[^\t]*\t"))
        if tail is not None:
            words = pc.binary_join_element_wise(words, tail, pa.scalar(" ", pa.large_string()))
        lang = pc.replace_substring(lang, ESCAPED, "\n")
        yield from pa.table({"lang": lang.cast(pa.string()), "gram": words.cast(pa.string()), "n": n}).to_batches()

    often = pc.and_(pc.greater_equal(edges["n"], min_count), pc.not_equal(edges["rest"], ""))
    often = edges.filter(often)
    yield from cut(often["node"], often["rest"], often["n"])
    node = edges.group_by("node").aggregate([("n", "sum")])
    kept = node.filter(pc.or_(
        pc.greater_equal(node["n_sum"], min_count), pc.is_in(node["node"], pa.array(hot, pa.large_string()))))
    kept = kept.filter(pc.match_substring_regex(kept["node"], "^[^ \t]+ "))
    yield from cut(kept["node"], None, kept["n_sum"])
    one = pc.replace_substring_regex(node["node"], "^([^ \t]+)[^\t]*\t", "\\1\t")
    words = pa.table({"node": one, "n": node["n_sum"]}).group_by("node").aggregate([("n", "sum")])
    yield from cut(words["node"], None, words["n_sum"])
    langs = pc.replace_substring_regex(words["node"], "^[^\t]*\t", "\t")
    total = pa.table({"node": langs, "n": words["n_sum"]}).group_by("node").aggregate([("n", "sum")])
    yield from cut(total["node"], None, total["n_sum"])


def _sum_parts(hot: Sequence[str], min_count: int):
    """Adds up the packed edges of one part after another; rows come sorted by part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tables, rows = None, [], 0
        for batch in batches:
            for part, packed in zip(batch.column("part").to_pylist(), batch.column("edges")):
                if part != now and tables:
                    yield from _part_flows(_add(tables), hot, min_count)
                    tables, rows = [], 0
                    give_back()
                now = part
                tables.append(_unpack(packed.as_buffer()))
                rows += tables[-1].num_rows
                if rows > 2 * tables[0].num_rows + ADDED_ROWS:
                    tables = [_add(tables)]
                    rows = tables[0].num_rows
        if tables:
            yield from _part_flows(_add(tables), hot, min_count)

    return run


def _node_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        nodes = edge_counts(batch.column("text"), batch.column("lang"))["node"].value_counts()
        if len(nodes):
            yield pa.RecordBatch.from_arrays([nodes.field("values"), nodes.field("counts")], ["node", "edges"])


def hot_nodes(docs: DataFrame) -> list[str]:
    """The ``HOT_NODES`` nodes that most edges leave, by a sample of documents.

    Any other leads to a small part of the edges. A node judged wrongly costs time, never counts.
    """
    sample = docs.sample(min(1.0, SAMPLED_DOCS / max(docs.count(), 1)), seed=1)
    found = _texts(sample).mapInArrow(_node_edges, "node string, edges long").groupBy("node").agg(F.sum("edges").alias("edges"))
    return [r["node"] for r in found.orderBy(F.desc("edges"), "node").limit(HOT_NODES).collect()]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("text", F.col("lang").cast("string").alias("lang"))


# ------------------------------------------------------------------------- the graph

def _first(gram: str | Column, words: int) -> Column:
    return F.substring_index(gram, " ", words)


def _n_words(gram: str | Column) -> Column:
    return F.length(gram) - F.length(F.translate(gram, " ", "")) + 1


def flows(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """Rows (lang, gram, n) of all runs of one to three words with at least this count.

    Counts of one and two words are flows. The empty gram has the count of all words. Edges are
    moved once, packed, to the part where their node lies, so its flow needs no further shuffle;
    words, and hot nodes, are summed from what parts have of them. A task adds up one part after
    another, and there are ``PARTS`` for each shuffle partition.
    """
    parts = PARTS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = hot_nodes(docs)
    packed = _texts(docs).mapInArrow(_packed_edges(hot, parts), "part int, edges binary")
    found = packed.repartition("part").sortWithinPartitions("part").mapInArrow(
        _sum_parts(hot, min_count), "lang string, gram string, n long"
    )
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(
        (F.col("n") >= min_count) | (F.col("gram") == "")
    )


def nodes(flow: DataFrame) -> DataFrame:
    """Rows (lang, gram, n, into, out): nodes, and the heaviest edge into and out of each."""
    edge = flow.where(_n_words("gram") == 3)
    none = F.lit(0).cast("long")
    sides = edge.select("lang", _first("gram", 2).alias("gram"), none.alias("into"), F.col("n").alias("out"))
    sides = sides.unionByName(
        edge.select("lang", _first("gram", -2).alias("gram"), F.col("n").alias("into"), none.alias("out"))
    ).groupBy("lang", "gram").agg(F.max("into").alias("into"), F.max("out").alias("out"))
    return flow.where(_n_words("gram") == 2).join(sides, ["lang", "gram"], "left").fillna(0, ["into", "out"])


def _linked(edge: DataFrame, inner: DataFrame) -> DataFrame:
    """Rows (lang, gram, head, steps): edges behind others, the first edge of their path, and how
    far it is. Distances double each round."""
    before = edge.select("lang", F.col("gram").alias("head"), _first("gram", -2).alias("node"))
    behind = edge.select("lang", "gram", _first("gram", 2).alias("node"))
    now = stored(
        inner.select("lang", F.col("gram").alias("node")).join(before, ["lang", "node"])
        .join(behind, ["lang", "node"]).select("lang", "gram", "head", F.lit(1).cast("long").alias("steps")),
        "linked",
    )
    while True:
        on = now.select("lang", F.col("gram").alias("head"), F.col("head").alias("further"), F.col("steps").alias("more"))
        if now.join(on, ["lang", "head"], "left_semi").isEmpty():
            return now
        now = stored(
            now.join(on, ["lang", "head"], "left").select(
                "lang", "gram", F.coalesce("further", "head").alias("head"),
                (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
            ),
            "linked",
        )


def paths(flow: DataFrame, node: DataFrame) -> DataFrame:
    """Rows (lang, words, n): edges joined through inner nodes; every edge is in one path.

    A path is no longer than the longest piece that occurs as often as the least count.
    """
    edge = flow.where(_n_words("gram") == 3)
    linked = _linked(edge, node.where("into = n AND out = n"))
    placed = edge.join(linked, ["lang", "gram"], "left").select(
        "lang", F.coalesce("head", "gram").alias("head"), F.coalesce("steps", F.lit(0)).alias("steps"),
        _first("gram", -1).alias("word"), "n",
    )
    return placed.groupBy("lang", "head").agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("steps", "word"))).alias("later")
    ).select(
        "lang", F.concat(F.split(_first("head", 2), " "), F.col("later.word")).alias("words"), "n"
    )


# -------------------------------------------------------------------------- candidates

def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (left right)), exact up to counts of 10^15."""
    a, left, right = (F.col(c).cast("decimal(19,0)") for c in (a, left, right))
    return F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * a * a, left * right)


def _cut(cut: int, left: str, right: str) -> Column:
    return F.struct(
        _score("a", left, right).alias("score"), F.lit(cut).alias("cut"),
        F.col(left).alias("l"), F.col(right).alias("r"),
    )


def _with_count(df: DataFrame, table: DataFrame, gram: str, out: str) -> DataFrame:
    return df.join(table.select("lang", F.col("gram").alias(gram), F.col("n").alias(out)), ["lang", gram])


def triples(path: DataFrame, node: DataFrame, word: DataFrame) -> DataFrame:
    """Scored runs of three words: (lang, phrase, a, best cut)."""
    ends = path.select(
        "*", F.concat_ws(" ", F.slice("words", 1, 2)).alias("first"), F.concat_ws(" ", F.slice("words", -2, 2)).alias("last")
    )
    ends = _with_count(_with_count(ends, node, "first", "n_first"), node, "last", "n_last")
    at = F.col("at")
    runs = ends.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - 2)).alias("at")).select(
        "lang", F.col("n").alias("a"), F.concat_ws(" ", F.slice("words", at, F.lit(3))).alias("phrase"),
        F.element_at("words", at).alias("w1"), F.element_at("words", at + 2).alias("w3"),
        F.when(at == 1, F.col("n_first")).otherwise(F.col("n")).alias("n12"),
        F.when(at == F.size("words") - 2, F.col("n_last")).otherwise(F.col("n")).alias("n23"),
    )
    runs = _with_count(_with_count(runs, word, "w1", "n1"), word, "w3", "n3")
    return runs.select("lang", "phrase", "a", F.least(_cut(1, "n1", "n23"), _cut(2, "n12", "n3")).alias("best"))


def pairs(node: DataFrame, word: DataFrame, covered: int = COVERED) -> DataFrame:
    """Scored runs of two words that no run of three covers; inner nodes are always covered."""
    kept = node.where(100 * F.greatest("into", "out") < covered * F.col("n")).select(
        "lang", F.col("gram").alias("phrase"), F.col("n").alias("a"),
        _first("gram", 1).alias("w1"), _first("gram", -1).alias("w2"),
    )
    kept = _with_count(_with_count(kept, word, "w1", "n1"), word, "w2", "n2")
    return kept.select("lang", "phrase", "a", _cut(1, "n1", "n2").alias("best"))


def collocations(
    docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, covered: int = COVERED
) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language.

    Phrases have two or three words and at least ``min_count`` occurrences ``a``. ``l`` and ``r`` are
    the counts of the parts at the cut that scores lowest. A phrase of two words is left out
    where a longer one holds it in at least ``covered`` of a hundred of its occurrences.
    """
    flow = stored(flows(docs, min_count), "flows")
    node = stored(nodes(flow), "nodes")
    word = flow.where((_n_words("gram") == 1) & (F.col("gram") != ""))
    found = triples(paths(flow, node), node, word).unionByName(pairs(node, word, covered)).select(
        "lang", "phrase", "a", "best.l", "best.r", "best.score"
    )
    order = [F.desc("score"), F.desc("a"), "phrase"]
    ahead = found.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(RANK_SLICES))).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))
    ).where(F.col("rank") <= top)
    ranked = ahead.withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    ).where(F.col("rank") <= top)
    total = flow.where("gram = ''").select("lang", "n")
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

"""Exact Jaccard join of shingle sets by a token-group matrix.

Documents are put into groups, a group's tokens are united, and a document is compared with the
members of a group only if enough of its tokens are in the union. This is done twice. At first
all other documents are one group: a document with too many tokens of its own, first among
its least hashes and then among all, links with none. The rest is put into small groups of
similar documents. A document of n shingles links only with documents that have at least 0.8 n of
them, so one of any n div 5 + 1 of its tokens must be in a group's union; its rarest are
looked up. Groups that pass are opened, in bounded parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandmill.llm.components import connected_components
from strandmill.llm.shingles import shingle_sets
from strandmill.llm.store import semi_join, stored
from strandmill.llm.text_arrays import column_texts, text_slices

#: Documents link if 100 * intersection >= PERCENT * union.
PERCENT = 80
GROUP_MEMBERS = 96
PART_QUERIES = 256
#: Queries of a part whose overlaps are counted together.
COUNTED = 32

OWN_MOST = "div(n, 5)"
#: Least hashes that are looked at first, and how many of them any linked document shares.
FIRST_LOOK = "least(n, div(n, 5) + div(n, 10) + 1)"
FIRST_SHARED = "div(div(4 * n + 4, 5), 10) + 1"


def document_sets(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n, digest): size and digest of each document's set; null ids are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            tokens, offsets = shingle_sets(column_texts(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets)), _digests(tokens, offsets)],
                names=["doc_id", "n", "digest"],
            )

    return _known(docs).mapInArrow(run, "doc_id long, n long, digest binary")


def _digests(tokens: np.ndarray, offsets: np.ndarray) -> pa.Array:
    parts = np.split(tokens, offsets[1:-1])
    return pa.array([xxhash.xxh3_128_digest(part.tobytes()) for part in parts], pa.binary())


def _known(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")


def _first_tokens(docs: DataFrame) -> DataFrame:
    """Rows (token, key): the least hashes of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            tokens, offsets = shingle_sets(column_texts(batch))
            n = np.diff(offsets)
            looked = np.minimum(n, n // 5 + n // 10 + 1)
            rows = np.repeat(np.arange(len(n)), n)
            taken = np.arange(len(tokens)) - offsets[rows] < looked[rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens[taken].view(np.int64)), batch.column("doc_id").take(pa.array(rows[taken]))],
                names=["token", "key"],
            )

    return _known(docs).mapInArrow(run, "token long, key long")


def _whole_sets(docs: DataFrame) -> DataFrame:
    """Rows (key, digest, tokens) of whole sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            tokens, offsets = shingle_sets(column_texts(batch))
            lists = pa.ListArray.from_arrays(
                pa.array(offsets.astype(np.int32)), pa.array(tokens.view(np.int64))
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), _digests(tokens, offsets), lists],
                names=["key", "digest", "tokens"],
            )

    return docs.mapInArrow(run, "key long, digest binary, tokens array<long>")


def _own_tokens(tokens: DataFrame) -> DataFrame:
    """Rows (key, own): how many of its tokens no other key has, for keys that have any."""
    return (
        tokens.groupBy("token").agg(F.min("key").alias("key"), F.max("key").alias("last"))
        .where("key = last").groupBy("key").agg(F.count("*").alias("own"))
    )


def _may_link(sets: DataFrame, own: DataFrame, most: str) -> DataFrame:
    """``sets`` (key, n, ...) without those that have more than ``most`` tokens of their own."""
    return sets.join(own, "key", "left").where(f"coalesce(own, 0) <= {most}").drop("own")


def _rare_tokens(sets: DataFrame) -> DataFrame:
    """Rows (token, key): each set's n div 5 + 1 rarest tokens, as far as other sets have them."""
    rows = sets.select("key", "n", F.explode("tokens").alias("token"))
    shared = rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    of_set = Window.partitionBy("key")
    place = F.row_number().over(of_set.orderBy("df", "token"))
    own = F.col("n") - F.count("*").over(of_set)
    return (
        rows.join(shared.hint("merge"), "token").withColumn("place", place + own)
        .where("place <= div(n, 5) + 1").select("token", "key")
    )


def _groups(rare: DataFrame) -> DataFrame:
    """Rows (key, team, part): groups of sets that share rare tokens, cut by a hash of the key."""
    heads = rare.groupBy("token").agg(F.min("key").alias("head"))
    teams = rare.join(heads, "token").groupBy("key").agg(F.min("head").alias("team"))
    sizes = teams.groupBy("team").agg(F.ceil(F.count("*") / GROUP_MEMBERS).alias("parts"))
    part = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    return teams.join(sizes, "team").select("key", "team", part.alias("part"))


def _qualifying(rare: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (key, team, part, own): groups whose union has one of the key's rare tokens.

    Of two groups the members of the lesser one are looked up in the other; ``own`` marks a
    key's own group.
    """
    placed = rare.join(groups, "key")
    matrix = placed.select("token", "team", "part").distinct()
    mine = placed.select("token", "key", F.struct("team", "part").alias("mine"))
    theirs = F.struct("team", "part")
    return (
        mine.join(matrix, "token").where(F.col("mine") <= theirs)
        .select("key", "team", "part", (F.col("mine") == theirs).alias("own")).distinct()
    )


def _overlaps(queries: list[np.ndarray], members: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sorted sets; 0 where the members' union rules a link out."""
    sizes = np.array([len(m) for m in members])
    flat = np.concatenate(members)
    order = np.argsort(flat, kind="stable")
    owner = np.repeat(np.arange(len(members)), sizes)[order]
    union, first = np.unique(flat[order], return_index=True)
    ends = np.append(first, len(flat))
    out = np.zeros((len(queries), len(members)), np.int64)
    for start in range(0, len(queries), COUNTED):
        cells = []
        for i, query in enumerate(queries[start:start + COUNTED], start):
            at = np.minimum(np.searchsorted(union, query), len(union) - 1)
            at = at[union[at] == query]
            if 100 * len(at) < PERCENT * len(query):
                continue
            counts = ends[at + 1] - ends[at]
            runs = np.repeat(ends[at] - (np.cumsum(counts) - counts), counts)
            cells.append(i * len(members) + owner[np.arange(counts.sum()) + runs])
        if cells:
            out += np.bincount(np.concatenate(cells), minlength=out.size).reshape(out.shape)
    return out


def _sets_of(table: pa.Table) -> list[np.ndarray]:
    column = table.column("tokens").combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    offsets = column.offsets.to_numpy()
    flat = column.flatten().to_numpy()
    return np.split(flat, (offsets - offsets[0])[1:-1])


def _open(queries: pa.Table, members: pa.Table) -> pa.Table:
    """Compares queries with the members of a group.

    Gives each key the least key that it reaches by links found here, and the number of documents
    behind these links.
    """
    if not queries.num_rows or not members.num_rows:
        return pa.table({c: pa.array([], pa.int64()) for c in ("key", "label", "links")})
    key, other = (t.column("key").to_numpy() for t in (queries, members))
    copies, others = (t.column("copies").to_numpy() for t in (queries, members))
    own = queries.column("own").to_numpy().astype(bool)
    a, b = _sets_of(queries), _sets_of(members)
    shared = _overlaps(a, b)
    union = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :] - shared
    linked = (100 * shared >= PERCENT * union) & (shared > 0) & (key[:, None] != other[None, :])
    far = np.iinfo(np.int64).max
    label, label_other = key.copy(), other.copy()
    while True:
        new = np.minimum(label, np.where(linked, label_other[None, :], far).min(1))
        new_other = np.minimum(label_other, np.where(linked, new[:, None], far).min(0))
        if (new == label).all() and (new_other == label_other).all():
            break
        label, label_other = new, new_other
    links = (linked * others[None, :]).sum(1)
    # Members of the queries' own group are queries too, and count their links there.
    links_other = (linked * copies[:, None] * ~own[:, None]).sum(0)
    keys = np.concatenate([key, other])
    labels, found = np.concatenate([label, label_other]), np.concatenate([links, links_other])
    keep = (labels < keys) | (found > 0)
    return pa.table({"key": keys[keep], "label": labels[keep], "links": found[keep]})


def _compare(pairs: DataFrame, groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (key, label, links) from opening the qualifying groups in bounded parts."""
    slices = pairs.groupBy("team", "part").agg(
        F.ceil(F.count("*") / PART_QUERIES).cast("int").alias("slices")
    )
    one = F.pmod(F.xxhash64("key"), F.col("slices")).cast("int")
    columns = ["team", "part", "slice", "key", "copies", "tokens"]
    queries = (
        pairs.join(slices, ["team", "part"]).withColumn("slice", one).join(sets, "key")
        .select(*columns, "own")
    )
    members = (
        groups.join(slices, ["team", "part"])
        .withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        .join(sets, "key").select(*(F.col(c).alias(c) for c in columns))
    )
    by = ["team", "part", "slice"]
    return queries.groupBy(*by).cogroup(members.groupBy(*by)).applyInArrow(
        _open, "key long, label long, links long"
    )


def linked_documents(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, n_links), one per document.

    Two documents link if 100 times the size of the intersection of their sets is at least 80
    times that of the union; ``component_id`` is the smallest doc_id that links reach, and
    ``n_links`` counts the documents linked with this one. A null or empty text, or one without
    words, has no shingles and links with nothing. Rows that share an id are one document, whose
    links are those of its text with the least digest; a null id has a null component and no
    links. Other columns are not looked at.
    """
    every = stored(document_sets(docs), "set-digests")
    texts = every.groupBy("doc_id").agg(F.min(F.struct("digest", "n")).alias("set")).select(
        "doc_id", "set.*"
    )
    kinds = stored(
        texts.where("n > 0").groupBy("digest", "n")
        .agg(F.min("doc_id").alias("key"), F.count("*").alias("copies")), "set-kinds",
    )
    own = _own_tokens(_first_tokens(docs))
    maybe = stored(_may_link(kinds, own, f"{FIRST_LOOK} - ({FIRST_SHARED})"), "sets-first-look")
    chosen = semi_join(_known(docs), maybe.select(F.col("key").alias("doc_id")), "doc_id")
    whole = semi_join(_whole_sets(chosen), maybe.select("key", "digest"), ["key", "digest"])
    sets = stored(whole.select("key", "tokens"), "sets-whole")
    tokens = sets.select("key", F.explode("tokens").alias("token"))
    left = _may_link(maybe.select("key", "n", "copies"), _own_tokens(tokens), OWN_MOST)
    sets = stored(
        sets.hint("merge").join(left, "key").dropDuplicates(["key"]), "sets-left"
    )
    rare = stored(_rare_tokens(sets), "rare-tokens")
    groups = stored(_groups(rare), "groups")
    found = stored(
        _compare(stored(_qualifying(rare, groups), "qualifying"), groups, sets), "links-found"
    )
    labels = connected_components(found.select(F.col("key").alias("a"), F.col("label").alias("b")))
    more = found.groupBy("key").agg(F.sum("links").alias("links"))
    of_kind = (
        kinds.join(labels, "key", "left").join(more, "key", "left")
        .select(
            "digest", "n", F.coalesce("label", "key").alias("component_id"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    of_doc = texts.join(of_kind, ["digest", "n"]).select("doc_id", "component_id", "n_links")
    known = every.join(of_doc, "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
    return known.unionByName(_without_id(docs))


def _without_id(docs: DataFrame) -> DataFrame:
    """Result rows of documents without an id."""
    lost = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            n = np.diff(shingle_sets(column_texts(batch))[1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n)], names=["doc_id", "n"])

    none = F.lit(None).cast("long")
    return lost.mapInArrow(run, "doc_id long, n long").select(
        "doc_id", F.col("n").alias("n_shingles"), none.alias("component_id"), F.lit(0).cast("long").alias("n_links")
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id.

    Documents without words, and those without an id, all stay. Rows that repeat the id of the
    one that stays are that document.
    """
    gone = (
        linked_documents(docs).where("component_id <> doc_id").select("doc_id").distinct()
    )
    return semi_join(docs, stored(gone, "near-copies"), "doc_id", "left_anti")



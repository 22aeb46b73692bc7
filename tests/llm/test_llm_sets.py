"""Shingle sets, the Jaccard join, components and decontamination against plain Python."""

import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import docs_of, edited, prose, shingles

from strandmill.llm import decontaminate, jaccard, store
from strandmill.llm.components import connected_components
from strandmill.llm.shingles import shingle_sets
from strandmill.llm.text_arrays import split_words, text_slices


def near_copies():
    base, other = prose(1, 120), prose(2, 90)
    texts = [base, *(edited(base, s, 1 + s % 6) for s in range(40)), other]
    texts += [edited(other, s, 2) for s in range(12)] + [base, base, other.upper()]
    texts += [prose(s, 5 + 11 * (s % 20)) for s in range(3, 40)]
    texts += [f"{prose(50 + s, 30)} {base[:200]}" for s in range(20)]
    return texts + ["one two", "one two", "one  TWO\n", "a b c d e", "", " \n\t", None, "x", "five"]


def expected_links(rows):
    sets = {i: frozenset(shingles(t)) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    return {i: (len(s), find(i), links[i]) for i, s in sets.items()}


def found_links(df):
    return {r[0]: tuple(r[1:]) for r in df.select(
        "doc_id", "n_shingles", "component_id", "n_links").collect()}


def test_shingle_sets():
    texts = near_copies()
    tokens, offsets = shingle_sets(pa.array([t or "" for t in texts]))
    assert np.diff(offsets).tolist() == [len(set(shingles(t))) for t in texts]
    for a, b in zip(offsets[:-1], offsets[1:]):
        assert (np.diff(tokens[a:b].astype(object)) > 0).all()


def test_words_keep_empty_texts_apart():
    ids, distinct, offsets = split_words(pa.array(["", " a  b", "\x0bA\xa0b c ", "", "c"]), lower=True)
    words = [distinct[i].as_py() for i in ids]
    assert [words[a:b] for a, b in zip(offsets[:-1], offsets[1:])] == [
        [], ["a", "b"], ["a\xa0b", "c"], [], ["c"]]


def test_slices_hold_every_row_once():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * n for n in (5, 50, 0, 7, 200, 1)] + [None]})
    parts = list(text_slices([batch], max_bytes=20))
    assert [t for p in parts for t in p.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert len(parts) > 3


@pytest.mark.parametrize("small", [False, True])
def test_links_equal_brute_force(spark, monkeypatch, small):
    if small:  # many bounded groups and parts, and no side is broadcast
        monkeypatch.setattr(jaccard, "GROUP_MEMBERS", 3)
        monkeypatch.setattr(jaccard, "PART_QUERIES", 2)
        monkeypatch.setattr(jaccard, "COUNTED", 3)
        monkeypatch.setattr(store, "SENT_IDS", 0)
    texts = near_copies()
    assert found_links(jaccard.linked_documents(docs_of(spark, texts, clash=True))) == expected_links(
        list(enumerate(texts)))


def test_links_of_repeated_and_missing_ids(spark):
    base = prose(9, 40)
    rows = [(5, base), (5, base), (3, base), (None, base), (None, None), (8, edited(base, 1, 9))]
    df = jaccard.linked_documents(docs_of(spark, rows))
    n = len(set(shingles(base)))
    got = sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "n_links").collect()), key=repr)
    assert got == sorted([
        (5, n, 3, 1), (5, n, 3, 1), (3, n, 3, 1), (None, n, None, 0), (None, 0, None, 0),
        (8, len(set(shingles(edited(base, 1, 9)))), 8, 0),
    ], key=repr)
    kept = jaccard.keep_first(docs_of(spark, rows)).select("doc_id").collect()
    assert sorted((r[0] for r in kept), key=repr) == sorted([3, 8, None, None], key=repr)


def test_no_documents(spark):
    none = docs_of(spark, [])
    assert jaccard.linked_documents(none).count() == 0
    assert jaccard.keep_first(none).count() == 0


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 60)] + [(100, 7), (200, 201), (201, 200), (300, 300), (5, 5)]
    df = connected_components(spark.createDataFrame(pairs, "a long, b long"))
    want = {i: 1 for i in [*range(1, 61), 100]} | {200: 200, 201: 200}
    assert {r.key: r.label for r in df.collect()} == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------------------ decontamination


def expected_leaks(rows, items):
    """All windows of item length that begin with a shingle of an item of that length."""
    out = {}
    grams = {i: shingles(t) for i, t in items}
    for doc, text in rows:
        have = shingles(text)
        for item, wanted in grams.items():
            size = len(wanted)
            if not size or not have:
                continue
            same_size = {g for w in grams.values() if len(w) == size for g in w}
            starts = {min(p, max(len(have) - size, 0)) for p, g in enumerate(have) if g in same_size}
            near = []
            for start in starts:
                window = Counter(have[start:start + size])
                both = sum((window & Counter(wanted)).values())
                union = sum(window.values()) + size - both
                if 100 * both >= 80 * union:
                    near.append((round(both / union, 9), -start))
            if near:
                top = max(near)
                out[doc, item] = (top[0], len(near), -top[1])
    return out


def leak_tables():
    items = [(1, prose(21, 40)), (2, prose(22, 60)), (3, "so it goes"), (4, None), (5, " "),
             (None, prose(23, 30)), (6, "la " * 30), (7, prose(24, 40)), (8, prose(21, 40).upper())]
    text = {i: t for i, t in items}
    rows = [
        (0, f"{prose(30, 80)} {text[1]} {prose(31, 40)}"), (1, edited(text[2], 5, 1)), (2, text[1]),
        (3, f"{edited(text[1], 3, 1)} {prose(33, 30)}"), (4, "So  it\ngoes"), (5, "so it goes on"),
        (6, "LA " * 45), (7, prose(34, 200)), (8, None), (9, ""), (10, prose(23, 30)),
        (11, f"{prose(35, 20)} {' '.join(text[2].split()[:30])} {prose(36, 20)}"),
        (None, text[1]), (12, " ".join(text[2].split()[:56])), (2, text[1]),
        (13, f"{text[7]} and {text[1]} {text[7]}"),
    ]
    return rows, items


@pytest.mark.parametrize("sent", [10**6, 0])
def test_leaks_equal_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(decontaminate, "SENT_SHINGLES", sent)
    rows, items = leak_tables()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    df = decontaminate.leaks(docs_of(spark, rows, clash=True), benchmark)
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.n_windows, r.start) for r in df.collect()}
    want = expected_leaks([r for r in rows if r[0] is not None], [i for i in items if i[0] is not None])
    assert got == want
    assert {(0, 1), (1, 2), (2, 1), (4, 3), (6, 6), (12, 2), (13, 7)} <= set(got)
    left = decontaminate.without_leaks(docs_of(spark, rows, clash=True), benchmark)
    gone = {d for d, _ in want}
    assert sorted((r.doc_id for r in left.collect()), key=repr) == sorted(
        (i for i, _ in rows if i not in gone), key=repr)
    assert left.columns == docs_of(spark, rows, clash=True).columns


def test_filed_fingerprints_are_not_sent_to_every_task(spark, monkeypatch):
    plans = {}

    def spy(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return store.stored(df, name)

    monkeypatch.setattr(decontaminate, "stored", spy)
    rows, items = leak_tables()
    decontaminate.leaks(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    join = plans["fingerprint-pairs"]
    assert "Generate" in join and "SortMergeJoin" in join and "Broadcast" not in join


def test_leaks_of_nothing(spark):
    benchmark = spark.createDataFrame([(1, prose(1, 20))], "item_id long, text string")
    assert decontaminate.leaks(docs_of(spark, []), benchmark).count() == 0
    assert decontaminate.leaks(docs_of(spark, [prose(1, 20)]), benchmark.limit(0)).count() == 0


def test_similar_windows_are_within_the_radius(spark):
    """Fingerprints of windows at the least similarity lie within the radius."""
    rows = []
    for seed in range(300):
        text = prose(1000 + seed, 12 + seed % 60, 5000)
        words = text.split()
        cut = max(1, (len(words) - 4) // 9)  # shingles lost at the end and as many others gained
        other = " ".join(words[:len(words) - cut] + prose(5000 + seed, cut, 5000).split())
        if len(set(shingles(text)) & set(shingles(other))) * 1.8 >= 1.6 * len(shingles(text)):
            rows.append((seed, text, other))
    df = spark.createDataFrame(rows, "id long, a string, b string")
    from pyspark.sql import functions as F

    prints = [
        decontaminate.with_shingles(df.select("id", F.col(side).alias("text")), "id")
        .select("id", decontaminate.fingerprint(F.col("grams")).alias(side)) for side in "ab"
    ]
    far = prints[0].join(prints[1], "id").select(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("d"))
    distances = [r.d for r in far.collect()]
    assert len(distances) > 100 and max(distances) <= decontaminate.RADIUS

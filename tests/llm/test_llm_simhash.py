"""SimHash fingerprints and tiled comparison against plain Python."""

import itertools
import random

import numpy as np
import pytest
import xxhash
from helpers import docs_of, edited, prose, shingles

from strandmill.llm import simhash


def plain_print(text):
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles(text, 4)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, radius=4):
    prints = [plain_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if None not in (rows[a][0], rows[b][0]) and (prints[a] ^ prints[b]).bit_count() <= radius:
            parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(
        ((i, f"{prints[k]:016x}", None if i is None else least[find(k)]) for k, (i, _) in enumerate(rows)),
        key=repr,
    )


def texts():
    long, short = prose(1, 900), prose(2, 80)
    found = [long, long.upper(), *(edited(long, s, 1 + s % 4) for s in range(30))]
    found += [edited(short, s, 1) for s in range(20)] + [prose(s, 3 + 9 * s) for s in range(3, 30)]
    return found + ["", None, " \t\n", "one", "ONE ", "one two three", "a b c d", "é\xa0ü ß", "a  b\x0bc d"]


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("clash", [False, True])
def test_components_equal_brute_force(spark, clash):
    rows = list(enumerate(texts())) + [(None, texts()[0]), (None, None), (5, "another text"), (4, texts()[4])]
    random.Random(3).shuffle(rows)
    found = as_rows(simhash.near_copies(docs_of(spark, rows, clash)))
    assert found == plain_components(rows)
    assert len({c for _, _, c in found}) < len(rows) - 30


@pytest.mark.parametrize("tile", [3, 40])
def test_tiles_of_any_size_find_the_same(spark, tile):
    rows = list(enumerate(texts()))
    assert as_rows(simhash.near_copies(docs_of(spark, rows), tile=tile)) == plain_components(rows)


def test_no_rows(spark):
    assert simhash.near_copies(docs_of(spark, [])).collect() == []
    assert as_rows(simhash.near_copies(docs_of(spark, [(None, "a")]))) == [(None, f"{plain_print('a'):016x}", None)]


def test_a_very_long_text(spark):
    text = prose(9, 300_000)
    assert simhash.near_copies(docs_of(spark, [text, "x"])).where("doc_id = 0").first()[1] == f"{plain_print(text):016x}"


@pytest.mark.parametrize("one_tile", [True, False])
def test_forest_connects_what_all_pairs_connect(one_tile):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    prints = np.unique([c ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b))
                        for c in centres for a, b in rng.integers(0, 63, (40, 2))])
    prints = np.concatenate([prints, rng.integers(0, 2**63, 300, dtype=np.uint64)])
    cut = None if one_tile else 200
    sides = (prints, None) if one_tile else (prints[:cut], prints[cut:])
    a, b = simhash.forest(*sides, 4)
    assert len(a) < len(prints)
    assert (np.bitwise_count(a ^ b) <= 64).all()

    def groups(pairs):
        label = {int(p): int(p) for p in prints}
        for x, y in pairs:
            low, high = label[int(x)], label[int(y)]
            if low != high:
                label = {k: low if v == high else v for k, v in label.items()}
        classes = {}
        for k, v in label.items():
            classes.setdefault(v, set()).add(k)
        return sorted(map(sorted, classes.values()))

    far = np.bitwise_count(prints[:, None] ^ prints) <= 4
    if not one_tile:
        far[:cut, :cut] = far[cut:, cut:] = False
    assert groups(zip(a, b)) == groups((prints[i], prints[j]) for i, j in zip(*np.nonzero(far)))


def test_spark_hashes_shingles_alike(spark):
    shingle = "b c d é"
    found = spark.sql(f"SELECT xxhash64('{shingle}') AS h").first()["h"]
    assert found % 2**64 == xxhash.xxh64_intdigest(shingle.encode(), 42)

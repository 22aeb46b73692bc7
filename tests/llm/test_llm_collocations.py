"""Collocations against plain counting."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from strandmill.llm import collocations as co

SCHEMA = "doc_id long, text string, lang string"


def plain_counts(rows):
    counts = Counter()
    for _, text, lang in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            for i in range(len(words)):
                for k in (1, 2, 3):
                    if i + k <= len(words):
                        counts[lang or "und", tuple(words[i:i + k])] += 1
    return counts


def plainly(rows, least=10, top=2000):
    f = plain_counts(rows)
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    found = {}
    for (lang, words), a in candidates.items():
        if len(words) == 2 and any(
            100 * b >= 50 * a for (other, longer), b in candidates.items()
            if other == lang and len(longer) == 3 and words in (longer[:2], longer[1:])
        ):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = f[lang, words[:k]], f[lang, words[k:]]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return sorted(
        (lang, rank, p.decode(), -a, left, right, sum(c for k, c in f.items() if k[0] == lang and len(k[1]) == 1), -s)
        for lang, rows in found.items()
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)
    )


def corpus():
    rng = random.Random(7)
    line = "All Rights Reserved by the makers of this long repeated line of words"
    texts = []
    for i in range(160):
        words = [f"w{min(rng.randrange(40), rng.randrange(40))}" for _ in range(rng.randrange(60))]
        for k in range(0, len(words), 9):
            words.insert(k, rng.choice([".", ",\n", "new york,", "New York City", "\x0b", "!?", "\t", "\xa0", "é ß"]))
        texts.append(" ".join(words) + (f" {line}" if i % 3 else f"\n{line}.") * (i % 4))
    rows = [(i, t, rng.choice(["en", "de", None, "en"])) for i, t in enumerate(texts)]
    return rows + [(None, "new york new york", "en"), (1, None, "en"), (2, "", None), (3, " .,\n", "fr"), *[(9, "a b c", "x y")] * 12, *[(9, "a b c", "x\ty z\n")] * 12]


def as_rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("least, top", [(10, 2000), (3, 15), (1, 2000)])
def test_collocations_equal_plain_counts(spark, least, top):
    rows = corpus()
    want = plainly(rows, least, top)
    assert len(want) > 40
    assert as_rows(co.collocations(spark.createDataFrame(rows, SCHEMA).repartition(3), least, top)) == want


def test_clashing_columns_and_no_rows(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    more = docs.selectExpr("*", "'x' AS gram", "1 AS n", "'y' AS phrase", "2 AS rank", "3 AS steps", "'z' AS head")
    assert as_rows(co.collocations(more)) == as_rows(co.collocations(docs))
    assert as_rows(co.collocations(docs.limit(0))) == []
    assert as_rows(co.collocations(spark.createDataFrame([(1, None, None), (2, "..", "en")], SCHEMA))) == []


def test_flows_equal_counts(spark):
    rows = corpus()
    flow = co.flows(spark.createDataFrame(rows, SCHEMA), 1)
    want = {(lang, " ".join(words)): n for (lang, words), n in plain_counts(rows).items()}
    assert {(r.lang, r.gram): r.n for r in flow.where("gram <> ''").collect()} == want


def test_paths_are_compact(spark):
    rows = corpus()
    flow = co.flows(spark.createDataFrame(rows, SCHEMA), 10).cache()
    node = co.nodes(flow)
    found = [(r.lang, r.words, r.n) for r in co.paths(flow, node).collect()]
    f = plain_counts(rows)
    covered = Counter()
    for lang, words, n in found:
        for i in range(len(words) - 2):
            assert f[lang, tuple(words[i:i + 3])] == n
            covered[lang, " ".join(words[i:i + 3])] += 1
        for i in range(1, len(words) - 2):
            assert f[lang, tuple(words[i:i + 2])] == n
    edges = {(r.lang, r.gram) for r in flow.collect() if r.gram.count(" ") == 2}
    assert set(covered) == edges and max(covered.values()) == 1
    assert max(len(words) for _, words, _ in found) >= 13
    inner = {(r.lang, r.gram) for r in node.where("into = n AND out = n").collect()}
    ends = {(lang, " ".join(e)) for lang, w, _ in found for e in (w[:2], w[-2:])}
    assert not inner & ends


def as_counts(table):
    keys = [tuple(reversed(r["node"].split("\t", 1))) for r in table.to_pylist()]
    keys = [(lang, f"{node} {rest}" if rest else node) for (lang, node), rest in zip(keys, table["rest"].to_pylist())]
    return dict(zip(keys, table["n"].to_pylist()))


def test_long_texts_and_large_vocabularies():
    texts = pa.array(["a b. c " * 200_000, None, "b c"])
    langs = pa.array(["en", "en", None])
    assert as_counts(co.edge_counts(texts, langs)) == {
        ("en", "a b"): 200_000, ("en", "b"): 200_000, ("en", "c a b"): 199_999, ("en", "c"): 1,
        ("und", "b c"): 1, ("und", "c"): 1}
    many = pa.array([" ".join(f"x{i}" for i in range(2_200_000))])
    found = co.edge_counts(many, pa.array(["en"]))
    assert found.num_rows == 2_200_000 and found["node"][0].as_py() == "x0 x1\ten" and found["rest"][0].as_py() == "x2"


def test_edges_lie_where_their_node_is(spark):
    texts, langs = pa.array(["a b c a b d a b. a b", "a b c"]), pa.array(["en", "de"])
    plain, got = (co.edge_counts(texts, langs, h) for h in ([], ["a b\ten", "b c\tfr", "zz a\ten"]))
    assert as_counts(got) == as_counts(plain)

    def places(table, node):
        return {r["place"] for r in table.to_pylist() if r["node"] == node}

    assert len(places(plain, "a b\ten")) == 1 and len(places(got, "a b\ten")) == 3
    assert places(plain, "a b\ten") != places(plain, "a b\tde") == places(got, "a b\tde")
    other = co.edge_counts(pa.array(["x y z. a b q"]), pa.array(["en"]))
    assert places(other, "a b\ten") == places(plain, "a b\ten")
    docs = spark.createDataFrame([(1, "a b c a b d a b e", "en"), (2, "a b", "de")], SCHEMA)
    assert co.hot_nodes(docs)[0] == "a b\ten"


def test_packed_edges():
    table = co.edge_counts(pa.array(["a b c a b d. é", "a"]), pa.array(["en", "d e"]))
    table = table.set_column(2, "rest", table["rest"].fill_null(""))
    assert co._unpack(pa.py_buffer(co._pack(table))).to_pylist() == table.select(["node", "rest", "n"]).to_pylist()


@pytest.mark.parametrize("hot", [0, 3])
def test_slices_change_no_count(spark, monkeypatch, hot):
    monkeypatch.setattr(co, "HOT_NODES", hot)
    monkeypatch.setattr(co, "ADDED_ROWS", 5)
    rows = corpus()
    assert as_rows(co.collocations(spark.createDataFrame(rows, SCHEMA))) == plainly(rows)


def test_scores_are_exact(spark):
    big = spark.createDataFrame([(10**14 + 7, 3 * 10**14 + 1, 10**14 + 9)], "a long, l long, r long")
    a, left, right = big.first()
    assert big.select(co._score("a", "l", "r")).first()[0] == 10**6 * a * a // (left * right)

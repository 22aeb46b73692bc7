"""Quality rules, language id and substring dedup."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from helpers import DOCS, WORD, by_id, docs_of, edited, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandmill.llm import langid, quality, substrings

ODD = [None, "", " \n\t ", "one", "a b\n\na b\n a b\nc", "# $ | <x>", "é\xa0ü　z " * 30,
       "x" * 20000, "w " * 9000, "l\n" * 60, "the cat sat on the mat " * 12, "a b c a b c d"]


# ------------------------------------------------------------------------ quality


def base_counts(text):
    text = text or ""
    words = WORD.findall(text.encode())
    lines = [x for x in text.split("\n") if WORD.search(x.encode())]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    n = len(words)
    return (
        n, sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n,
    )


NOTHING = quality.Ratios(*np.zeros((2, quality.N_BUCKETS), np.int64))


def no_ids(spark):
    return spark.createDataFrame([], "doc_id long, trusted boolean")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base_counts(spark):
    texts = ODD + [prose(s, 3 + 17 * s, 30) for s in range(12)] + [prose(99, 80) + "\n" + prose(99, 80)]
    got = by_id(quality.judge(docs_of(spark, texts, clash=True), NOTHING, no_ids(spark)),
                *COUNTS, "score", "kept")
    assert got == {i: (*base_counts(t), 0.0, not base_counts(t)[-1]) for i, t in enumerate(texts)}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t#\x0b\x1cé", max_size=120), min_size=1, max_size=5))
def test_base_counts_of_any_text(texts):
    found = quality.measure(pa.array(texts), NOTHING, -1.0)
    got = list(zip(*(found[c].tolist() for c in COUNTS)))
    assert got == [base_counts(t) for t in texts]


def marked(text):
    return " ".join(w + "&&&" for w in text.split())


def test_ratios_part_marked_from_clean_texts(spark):
    clean = [prose(s, 120, 60) for s in range(120)]
    bad = [marked(prose(1000 + s, 120, 60)) for s in range(40)]
    docs = docs_of(spark, clean + bad)
    labels = spark.createDataFrame(
        [(i, 1, 0) for i in range(0, 120, 3)] + [(0, 1, None), (3, 0, 0), (6, 1, 1), (None, 1, 0)],
        "doc_id long, quality int, toxic int")
    trusted = quality.trusted_ids(labels)
    assert {r.doc_id for r in trusted.collect()} == set(range(0, 120, 3)) - {3, 6}
    counts = quality.ngram_counts(docs, trusted)
    assert counts.agg({"raw": "sum"}).first()[0] == 160 * (120 + 119)
    assert counts.agg({"target": "sum"}).first()[0] == 38 * (120 + 119)
    ratios = quality.log_ratios(counts)
    kept = by_id(quality.judge(docs, ratios, trusted), "kept")
    assert kept == {i: (i < 120,) for i in range(160)}
    left = quality.keep_good(docs, ratios, trusted)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == set(range(120))
    one_by_one = [float(quality.measure(pa.array([t]), ratios, 0.0)["score"][0]) for t in clean[:5]]
    together = quality.measure(pa.array(clean[:5]), ratios, 0.0)["score"].tolist()
    assert one_by_one == together  # scores do not depend on batches


def test_no_trusted_text(spark):
    docs = docs_of(spark, [prose(1, 60), None])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    none = quality.trusted_ids(none)
    nothing = quality.log_ratios(quality.ngram_counts(docs, none))
    assert [r.score for r in quality.judge(docs, nothing, none).collect()] == [0.0, 0.0]
    empty = docs_of(spark, [])
    assert quality.judge(empty, quality.log_ratios(quality.ngram_counts(empty, none)), none).count() == 0


def plain_bucket(words):
    """The top bits of a hash of one word or two, in Python's integers."""
    def mixed(x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            x = (x ^ x >> shift) * factor % 2**64
        return x

    found = [xxhash.xxh3_64_intdigest(w) for w in words]
    whole = found[0] if len(found) == 1 else mixed((found[0] * 0x9E3779B97F4A7C15 + found[1]) % 2**64)
    return whole >> 64 - quality.BUCKET_BITS


def plain_score(text, texts, trusted, is_trusted):
    """The weighted mean log ratio, n-gram by n-gram."""
    def grams(t, n):
        words = WORD.findall((t or "").encode())
        return [plain_bucket(words[i:i + n]) for i in range(len(words) - n + 1)]

    total, n_grams = 0.0, 0
    for n in (1, 2):
        raw = Counter(g for t in texts for g in grams(t, n))
        target = Counter(g for t, good in zip(texts, trusted) if good for g in grams(t, n))
        own = Counter(grams(text, n))
        share = sum(target.values()) / sum(raw.values())
        for g, times in own.items():
            of_target = target[g] - (times if is_trusted else 0)
            ratio = np.log((of_target + quality.PRIOR) / ((raw[g] - times) * share + quality.PRIOR))
            weight = quality.TAIL_WEIGHT if n == 1 and ratio < quality.TAIL else 1
            total += times * weight * ratio
            n_grams += times
    return total / max(n_grams, 1)


def test_scores_and_verdicts_equal_a_plain_version(spark):
    insults = [f"{prose(500 + s, 70, 40)} boo hiss boo" for s in range(30)]
    texts = [prose(s, 60 + 5 * s, 90) for s in range(30)] + insults + [marked(prose(9, 80)), "boo " * 60, "few words"]
    texts += [texts[3], None]
    docs = docs_of(spark, texts, clash=True).withColumn("Trusted", F.lit("x"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    trusted = quality.trusted_ids(labels)
    ratios = quality.log_ratios(quality.ngram_counts(docs, trusted))
    good = [i < 20 for i in range(len(texts))]
    want = [plain_score(t, texts, good, g) for t, g in zip(texts, good)]
    got = by_id(quality.judge(docs, ratios, trusted), "score", "kept")
    assert [got[i][0] for i in range(len(texts))] == pytest.approx(want, abs=1e-5)
    verdicts = [not base_counts(t)[-1] and score >= quality.MIN_SCORE for t, score in zip(texts, want)]
    assert [got[i][1] for i in range(len(texts))] == verdicts
    assert all(verdicts[:20]) and not any(verdicts[30:60])
    left = quality.keep_good(docs, ratios, trusted)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [i for i, v in enumerate(verdicts) if v]


def local_ratios(texts, trusted):
    """Ratios without Spark, so that the number of buckets can be changed."""
    def parts(kept):
        batch = pa.RecordBatch.from_pydict({"text": kept})
        return [batch.slice(i, 1000) for i in range(0, len(kept), 1000)]

    packed = [*quality._count(parts(texts), 0)]
    packed += quality._count(parts([t for t, good in zip(texts, trusted) if good]), 1)
    counts = np.zeros((2, quality.N_BUCKETS), np.int64)
    for part in quality._sum_ranges(packed):
        bucket, *columns = (c.to_numpy() for c in part.columns)
        counts[:, bucket] = columns
    return quality.Ratios(*counts)


@pytest.fixture(scope="module")
def labelled():
    """For each size: texts, quality and toxicity of all documents, -1 without a label."""
    out = {}
    for size in ("sf0.01", "sf0.1"):
        docs, labels = (pq.read_table(f"/root/testdata/{size}/{t}.parquet") for t in ("documents", "labels"))
        known = {r["doc_id"]: (r["quality"], r["toxic"]) for r in labels.to_pylist()}
        texts = [t or "" for t in docs.column("text").to_pylist()]
        out[size] = texts, *np.array([known.get(i, (-1, -1)) for i in docs.column("doc_id").to_pylist()]).T
    return out


@pytest.mark.parametrize("size, fewer_bits", [("sf0.01", 0), ("sf0.01", 2), ("sf0.1", 0), ("sf0.1", 2)])
def test_junk_scores_low_at_any_size(labelled, monkeypatch, size, fewer_bits):
    """Junk that the base rules let pass, so that the score decides on it."""
    monkeypatch.setattr(quality, "BUCKET_BITS", quality.BUCKET_BITS - fewer_bits)
    monkeypatch.setattr(quality, "N_BUCKETS", 2 << quality.BUCKET_BITS)
    texts, good, toxic = labelled[size]
    trusted = (good == 1) & (toxic == 0)
    ratios = local_ratios(texts, trusted.tolist())
    junk = [t for t, g in zip(texts, good) if g == 0]
    found = quality.measure(pa.array(junk), ratios, quality.MIN_SCORE)
    assert np.mean(found["score"][~found["base_failed"]] < quality.MIN_SCORE) > 0.98
    assert found["kept"].sum() <= 1
    clean = [t for t, c in zip(texts, trusted) if c]
    found = quality.measure(pa.array(clean), ratios, quality.MIN_SCORE, np.ones(len(clean), bool))
    assert np.mean(found["score"] < quality.MIN_SCORE) < 0.015


@pytest.mark.parametrize("size, caught, lost", [("sf0.01", 0.6, 0.04), ("sf0.1", 0.8, 0.01)])
def test_toxic_documents_are_not_kept(labelled, size, caught, lost):
    """One in ten trusted documents is held out; nothing is counted of toxic labels."""
    texts, good, toxic = labelled[size]
    trusted = (good == 1) & (toxic == 0)
    held = trusted & (np.cumsum(trusted) % 10 == 0)
    ratios = local_ratios(texts, (trusted & ~held).tolist())
    bad = [t for t, c in zip(texts, (good == 1) & (toxic == 1)) if c]
    found = quality.measure(pa.array(bad), ratios, quality.MIN_SCORE)
    assert found["kept"][~found["base_failed"]].mean() < 1 - caught
    found = quality.measure(pa.array([t for t, c in zip(texts, held) if c]), ratios, quality.MIN_SCORE)
    assert 1 - found["kept"][~found["base_failed"]].mean() <= lost


def test_counts_survive_packing():
    counts = np.zeros(quality.N_BUCKETS, np.int64)
    at = np.array([0, 5, (1 << quality.RANGE_BITS) - 1, 1 << quality.RANGE_BITS, quality.N_BUCKETS - 1])
    counts[at] = [1, 1 << 40, 3, 255, 256]
    packed = quality._packed(counts, 1)
    assert packed.num_rows == 3 and packed.column("kind").to_pylist() == [1, 1, 1]
    tables = [quality._unpacked(c.as_py()) for c in packed.column("cells")]
    assert (np.concatenate(tables, axis=1) == [at, counts[at]]).all()
    assert quality._packed(np.zeros(quality.N_BUCKETS, np.int64), 0).num_rows == 0


@pytest.mark.parametrize("most, kind", [(1 << 20, np.uint32), (1 << 40, np.int64)])
def test_counts_are_sent_to_the_driver_packed(spark, monkeypatch, most, kind):
    rng = np.random.default_rng(3)
    bucket = rng.permutation(quality.N_BUCKETS)[:60_000]
    raw = rng.integers(1, 2000, len(bucket))
    raw[7] = most
    target = raw // 3
    frame = type(spark.range(0))
    sent, to_arrow, collect = [], frame.toArrow, frame.collect

    def as_arrow(self):
        table = to_arrow(self)
        sent.append(table.nbytes)
        return table

    def as_rows(self):
        rows = collect(self)
        sent.append(sum(8 if isinstance(v, int) else len(v) for row in rows for v in row))
        return rows

    table = pa.table([pa.array(c) for c in (bucket, raw, target)], names=quality.COUNTED)
    counts = spark.createDataFrame(table).repartition(5)
    monkeypatch.setattr(frame, "toArrow", as_arrow)
    monkeypatch.setattr(frame, "collect", as_rows)
    ratios = quality.log_ratios(counts)
    assert ratios.raw.dtype == ratios.target.dtype == kind
    want = np.zeros((2, quality.N_BUCKETS), np.int64)
    want[:, bucket] = raw, target
    assert (ratios.raw == want[0]).all() and (ratios.target == want[1]).all()
    assert sum(sent) < table.nbytes / 2


# ------------------------------------------------------------------------ languages


def sentences(lang, seed):
    words = {"en": "the house and of with water they".split(), "de": "das haus und von mit wasser sie".split(),
             "fr": "la maison et de avec eau elles".split()}[lang]
    rng = np.random.RandomState(seed)
    return " ".join(rng.choice(words, 12 + seed % 30))


def test_languages_of_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    rows = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    right = [r.lang == r.lang_pred for r in held]
    assert len(held) > 250 and np.mean(right) > 0.97
    assert abs(np.mean([r.score for r in held]) - np.mean(right)) < 0.05  # calibrated
    assert (model.weights == 0).mean() > 0.3  # L1 leaves unused features out


def test_language_edge_cases(spark):
    texts = [sentences(lang, s) for s in range(60) for lang in ("en", "de", "fr")] + ODD + ["123 456", "١٢"]
    rows = [(i, t, "en de fr".split()[i % 3] if i < 180 else None) for i, t in enumerate(texts)]
    rows += [(None, sentences("de", 3), "de"), (7, texts[7], "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.predict(docs.selectExpr("*", "'x' held_out", "1 score"), langid.fit(docs)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(texts):
        if t is None or not any(map(str.isalpha, t)):
            assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
        else:
            assert by[i].lang_pred in ("en", "de", "fr") and 0 <= by[i].score <= 1
    assert all(by[i].lang_pred == "en de fr".split()[i % 3] for i in range(180))
    import zlib
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(180))
    assert by[None].held_out is False


def test_nothing_to_learn(spark):
    docs = docs_of(spark, ["abc", None])
    assert langid.fit(docs) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(docs_of(spark, []), None).count() == 0


def test_long_text_is_cut_without_loss(monkeypatch):
    text = prose(5, 400) + " äöü " * 50
    whole = [c for _, c, _ in langid.count_chunks([text])][0]
    monkeypatch.setattr(langid, "SEGMENT", 97)
    assert (whole == [c for _, c, _ in langid.count_chunks([text])][0]).all()


def test_features_are_ngrams_within_words():
    text = "Ab, cd-é"
    _, counts, has = next(langid.count_chunks([text]))
    words = ["ab", "cd", "é"]
    n = sum(len(g) for w in words for g in [[f" {w} "[i:i + k] for k in range(1, 5)
            for i in range(len(w) + 3 - k) if f" {w} "[i:i + k].strip()]])
    assert counts.sum() == n and has.tolist() == [True]


# ------------------------------------------------------------------------ substrings


def plain_chunks(text, rounds=True):
    """Chunks by loops over words, with the gear hash rolled byte by byte."""
    raw = text.encode()
    hashes, h = [], 0
    for byte in raw:
        h = ((h << 1) + int(substrings.GEAR[byte])) & 0xFFFF
        hashes.append(h)
    words = [(m.start(), m.end()) for m in WORD.finditer(raw)]
    own, reach = [hashes[a] for a, _ in words], substrings.REACH
    begins = [i for i in range(len(words)) if i == 0 or (
        all(own[i] < own[j] for j in range(max(0, i - reach), i))
        and all(own[i] <= own[j] for j in range(i + 1, min(len(words), i + reach + 1)))
        and own[i] < (0xFFFF if i < reach else 0x10000))]
    if rounds:
        least = [i for i in range(len(words)) if i not in set(begins)
                 and all(own[i] <= own[j] for j in range(max(0, i - reach), min(len(words), i + reach + 1)))]
        further, rank = [], 0
        for before, i in zip([None, *least], least):
            near = before is not None and i - before <= reach and not any(before < b <= i for b in begins)
            rank = rank + 1 if near else 0
            if not near or rank % -(-substrings.ROUND_WORDS // (i - before)) == 0:
                further.append(i)
        begins = sorted(begins + further)
    cuts = begins + [len(words)]
    return [(words[a][0], words[b - 1][1], b - a) for a, b in zip(cuts, cuts[1:])]


@pytest.mark.parametrize("rounds", [False, True])
def test_chunks_equal_a_plain_loop(rounds):
    texts = [t or "" for t in ODD] + [prose(s, 200) for s in range(5)] + ["ümläut wörter " * 30]
    texts += [f"{prose(s, 9)} {'buy now cheap pills'[:3 + 4 * (s % 5)]} " * (s % 3) + prose(s, 40, 3) for s in range(40)]
    texts += ["a " * 50, "a b " * 40 + "c a b " * 30, prose(1, 300, 2), "", " x"]
    rows, start, stop, n, hi, lo = substrings.chunk_texts([t.encode() for t in texts], rounds=rounds)
    for i, text in enumerate(texts):
        at = rows == i
        assert list(zip(start[at].tolist(), stop[at].tolist(), n[at].tolist())) == plain_chunks(text, rounds)
    pieces = [texts[r].encode()[a:b] for r, a, b in zip(rows, start, stop)]
    assert len(set(pieces)) == len(set(zip(hi.tolist(), lo.tolist())))


def expected_passages(rows, min_words):
    places = {}
    for i, text in rows:
        seen = set()
        for at, (a, b, n) in enumerate(plain_chunks(text or "")):
            piece = (text or "").encode()[a:b]
            places.setdefault(piece, []).append((i, at, a, b, n, piece in seen))
            seen.add(piece)
    marks = {}
    for found in places.values():
        if len(found) > 1:
            low = min(f[0] for f in found)
            for i, at, a, b, n, again in found:
                marks.setdefault((i, i == low and not again), []).append((at, a, b, n))
    out = set()
    for (i, first), found in marks.items():
        run = []
        for f in sorted(found) + [(10**9, 0, 0, 0)]:
            if run and f[0] != run[-1][0] + 1:
                if sum(r[3] for r in run) >= min_words:
                    out.add((i, run[0][1], run[-1][2], sum(r[3] for r in run), first))
                run = []
            run.append(f)
    return out


def repeating():
    passage, other = prose(70, 60), prose(71, 55)
    return [
        prose(72, 100), f"{prose(73, 50)} {passage} {prose(74, 30)}", f"{prose(75, 20)}\n{passage}",
        f"{passage}\n{prose(76, 40)} {other}", prose(77, 80), f"{other} {prose(78, 30)} {other}",
        passage, prose(79, 40) + " " + " ".join(passage.split()[:9]), None, "", "  ", edited(prose(80, 200), 1, 2),
        prose(80, 200), "same short text", "same short text",
    ]


def test_passages_equal_brute_force(spark):
    texts = repeating()
    df = substrings.repeated_passages(docs_of(spark, texts, clash=True))
    got = {(r.doc_id, r.start, r.stop, r.n_words, r.is_first) for r in df.collect()}
    assert got == expected_passages(list(enumerate(texts)), substrings.MIN_WORDS)
    assert {1, 2, 3, 5, 6, 11, 12} == {g[0] for g in got}


def test_any_passage_of_51_words_is_found():
    for seed in range(60):
        passage = prose(seed, 51, 3000)
        a, b = (f"{prose(s, 40, 3000)} {passage} {prose(s + 1, 40, 3000)}" for s in (1000 + seed, 2000 + seed))
        assert {p[0] for p in expected_passages([(0, a), (1, b)], substrings.MIN_WORDS)} == {0, 1}


def shared_words(passage, before, after):
    """Words of the passage in chunks that both of two texts with it have, the longest run."""
    texts = [f"{b} {passage} {a}".encode() for b, a in zip(before, after)]
    rows, start, stop, n, hi, lo = substrings.chunk_texts(texts, rounds=True)
    keys = list(zip(hi.tolist(), lo.tolist()))
    other = {k for k, r in zip(keys, rows) if r == 1}
    best = run = 0
    for k, r, words in zip(keys, rows, n.tolist()):
        if r == 0:
            run = run + words if k in other else 0
            best = max(best, run)
    return best


def test_thousands_of_passages_of_51_words():
    least = 51
    for seed in range(4000):
        passage = prose(seed, 51, 3000)
        least = min(least, shared_words(passage, *(
            [prose(10**5 * k + 2 * seed + i, 12, 3000) for i in (0, 1)] for k in (1, 2))))
    assert least >= substrings.MIN_WORDS


@pytest.mark.parametrize("phrase", ["buy", "a", "buy now", "a b", "cheap pills here", "a b c", "the cat sat on the mat"])
def test_passages_of_repeated_words(phrase):
    for n_words in (51, 52, 53, 60, 200):
        words = phrase.split()
        passage = " ".join((words * n_words)[:n_words])
        for seed in range(40):
            sides = [[prose(1000 * k + 2 * seed + i, 12 + i, 3000) for i in (0, 1)] for k in (1, 2)]
            assert shared_words(passage, *sides) >= substrings.MIN_WORDS


def test_repeated_words_are_a_passage(spark):
    text = "buy now " * 30
    docs = docs_of(spark, [f"{prose(s, 30, 3000)} {text} {prose(s + 9, 30, 3000)}" for s in (1, 2)])
    found = substrings.repeated_passages(docs).where("doc_id = 1").collect()
    assert sum(r.n_words for r in found) >= 40
    left = {r.doc_id: r.text for r in substrings.without_repeats(docs).collect()}
    assert left[1].count("buy now") < 12


def test_repeats_are_cut_out(spark):
    texts = repeating()
    docs = docs_of(spark, texts, clash=True)
    left = substrings.without_repeats(docs)
    assert left.columns == docs.columns
    got = {r.doc_id: r for r in left.collect()}
    cuts = expected_passages(list(enumerate(texts)), substrings.MIN_WORDS)
    for i, text in enumerate(texts):
        spans = sorted((a, b) for d, a, b, _, first in cuts if d == i and not first)
        want = substrings.cut_out(text.encode(), spans) if spans else text
        if spans and not want.strip():
            assert i not in got
        else:
            assert got[i].text == want and got[i].n_chars == (None if text is None else len(want))


def test_rows_that_share_an_id_are_no_repeats(spark):
    text = prose(90, 70)
    rows = [(4, text), (4, text), (None, text), (9, prose(91, 70)), (9, prose(91, 70))]
    df = substrings.repeated_passages(docs_of(spark, rows))
    assert {(r.doc_id, r.is_first) for r in df.collect()} == {(4, False)}  # the row without id comes first
    kept = substrings.without_repeats(docs_of(spark, rows[1:])).collect()
    assert sorted((r.doc_id for r in kept), key=repr) == sorted([None, 9, 9], key=repr)
    assert substrings.repeated_passages(docs_of(spark, rows[3:])).count() == 0
    assert substrings.repeated_passages(docs_of(spark, [])).count() == 0
    assert substrings.without_repeats(docs_of(spark, [])).count() == 0


def test_texts_without_words(spark):
    assert all(len(v) == 0 for v in substrings.chunk_texts([b"", b"  "], rounds=True))
    assert all(len(v) == 0 for v in substrings.chunk_texts([]))
    text = prose(92, 80)
    for rows in ([(1, None)], [(1, ""), (2, " \n")], [(1, text), (2, text), (3, None)]):
        docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).repartition(len(rows), "doc_id")
        assert substrings.repeated_passages(docs).count() == (2 if len(rows) == 3 else 0)
        assert substrings.without_repeats(docs).count() == (2 if len(rows) == 3 else len(rows))


def test_ids_with_several_texts_and_clashing_names(spark):
    text, other = prose(93, 80, 3000), prose(94, 60, 3000)
    rows = [(1, text), (1, "ü" * 3 + " " + other), (2, "é ä ö ß " + text), (2, None), (2, "é" * 700), (3, other + " end"), (3, other + " end")]
    docs = docs_of(spark, rows).selectExpr("*", "'i' AS cut_id", "'r' AS cuts", "'q' AS cut_ranges", "1 AS version", "2 AS run")
    left = substrings.without_repeats(docs)
    assert left.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in left.collect()), key=repr)
    untouched = [r for r in rows if r[0] == 1 or r[1] in (None, "é" * 700)]
    assert all(r in kept for r in untouched)
    rest = list(kept)
    for r in untouched:
        rest.remove(r)
    assert {i for i, _ in rest} <= {2, 3} and all(text not in t and other not in t for _, t in rest)
    # The repeated row keeps or loses the passage as its copy does.
    assert len({t for i, t in rest if i == 3}) <= 1


@pytest.mark.parametrize("text", ["é" * 30 + " ", "a　b " * 20, "🇩🇪 " * 40])
def test_cuts_keep_characters_whole(text):
    rows, start, stop, *_ = substrings.chunk_texts([text.encode()])
    for a, b in zip(start, stop):
        substrings.cut_out(text.encode(), [(int(a), int(b))])
    assert re.sub(r"\s", "", text) or len(rows)

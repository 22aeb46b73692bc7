import json
import random
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE
from tokenizers.trainers import BpeTrainer

from strandmill.functions.text import SPECIAL_TOKENS
from strandmill.operators import bpe, bpe_index, bpe_kernel, vocab
from strandmill.plans.catalog import QUERIES
from strandmill.plans.catalog.tokens import fixed_model
from strandmill.plans.prepare import prepare_corpus
from strandmill.sources.writers import read_vocab, write_vocab

RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
# Fixed value: a well known protein.
GFP = (
    "MVSKGEELFTGVVPILVELDGDVNGHKFSVSGEGEGDATYGKLTLKFICTTGKLPVPWPTLVTTLTYGVQCFSRYPDHMKQHDFFKSAMPEGYVQERTIFFKDDGNYKTRAEVKFEGDTLVNRIELKGIDFKEDGNILGHKLEYNYNSHNVYIMADKQKNGIKVNFKIRHNIEDGSVQLADHYQQNTPIGDGPVLLPDNHYLSTQSALSKDPNEKRDHMVLLEFVTAAGITLGMDELYK"
)


def proteins(seed, n=120, alphabet=RESIDUES):
    rng = random.Random(seed)
    motifs = ["".join(rng.choices(alphabet, k=rng.randint(2, 6))) for _ in range(12)]
    out = []
    for _ in range(n):
        parts = [rng.choice(motifs) if rng.random() < 0.6 else rng.choice(alphabet) * rng.randint(1, 5) for _ in range(rng.randint(1, 25))]
        out.append("".join(parts))
    return out + out[: n // 3]


def library(texts, **options):
    tok = Tokenizer(BPE(unk_token="[UNK]"))
    tok.train_from_iterator(texts, BpeTrainer(special_tokens=list(SPECIAL_TOKENS), show_progress=False, **options))
    return tok


def merges_of(tok):
    return [tuple(m) for m in json.loads(tok.to_str())["model"]["merges"]]


def corpus(spark, texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")


@pytest.mark.parametrize("seed, options, alphabet", [
    (1, {"vocab_size": 60}, RESIDUES),
    (2, {"vocab_size": 70, "min_frequency": 40}, RESIDUES),
    (3, {"vocab_size": 70, "max_token_length": 3}, RESIDUES),
    (6, {"vocab_size": 60, "max_token_length": 5}, "ABCD"),
    (4, {"vocab_size": 40}, "AB"),
    (5, {"vocab_size": 60}, "aé\U0001f600 \n"),
])
def test_training_matches_the_library(spark, seed, options, alphabet):
    texts = proteins(seed, alphabet=alphabet)
    want = library(texts, **options)
    got = bpe.train_bpe(corpus(spark, texts), **options)
    assert [(got.tokens[a], got.tokens[b]) for a, b, _ in got.merges] == merges_of(want)
    assert got.ids == want.get_vocab()


@pytest.mark.parametrize("share", [0.0, 0.4, 100.0])
def test_counting_indexing_and_rewriting_agree(spark, monkeypatch, share):
    """Few looked-at pairs, frequent rewrites, and an index give the library's merges."""
    texts = proteins(11, n=60)
    want = library(texts, vocab_size=48)
    monkeypatch.setattr(bpe, "INDEX_SHARE", share)
    monkeypatch.setattr(bpe_index, "PASSES_PER_FOLD", 2)
    monkeypatch.setattr(bpe, "PAIRS_PER_PASS", 3)
    monkeypatch.setattr(bpe, "MERGES_PER_REWRITE", 2)
    got = bpe.train_bpe(corpus(spark, texts), vocab_size=48)
    assert [(got.tokens[a], got.tokens[b]) for a, b, _ in got.merges] == merges_of(want)


def plain_pairs(texts):
    found = {}
    for text, copies in texts:
        for pair in zip(text, text[1:]):
            found["".join(pair)] = found.get("".join(pair), 0) + copies
    return found


@pytest.mark.parametrize("buckets, fold", [(1, 16), (7, 2), (40, 3)])
def test_index_follows_the_texts(spark, monkeypatch, buckets, fold):
    monkeypatch.setattr(bpe_index, "PASSES_PER_FOLD", fold)
    texts = {(t, 1 + i % 3) for i, t in enumerate(sorted({*proteins(5, n=40), "XYXY", "ZZZZZ"})) if t}
    index = bpe_index.PairIndex(spark.createDataFrame(sorted(texts), "text string, copies long"), buckets)
    passes = [[("XY", "\u0100"), ("AC", "\u0101")], [("ZZ", "\u0102")], [("\u0102\u0102", "\u0103")],
              [("QQ", "\u0104"), ("AA", "\u0105")], [("no", "\u0106")], [("\u0100\u0100", "\u0107")]]
    for merges in passes:
        holders = {r.bucket for r in index.texts().collect() if any(p in r.text for p, _ in merges)}
        assert index.holders([p for p, _ in merges]) == sorted(holders)
        index.merge(merges)
        for pair, product in merges:
            texts = {(t.replace(pair, product), n) for t, n in texts}
        assert {(r.text, r.copies) for r in index.texts().collect()} == texts
        assert {r.pair: r.cnt for r in index.counts().collect()} == plain_pairs(texts)
    # Rare pairs are in few buckets; a pair that no text has is in none.
    assert index.touched[4] == 0 and index.touched[2] == index.touched[5] == 1
    assert max(index.touched) <= buckets


def test_tables_of_training_are_deleted(spark):
    shared = Path(spark.conf.get("spark.checkpoint.dir")) / spark.sparkContext.applicationId
    before = set(shared.glob("*"))
    bpe.train_bpe(corpus(spark, proteins(11, n=60)), vocab_size=40)
    assert set(shared.glob("*")) == before


def test_training_on_nothing(spark):
    model = bpe.train_bpe(corpus(spark, [""]), vocab_size=50)
    assert model.tokens == list(SPECIAL_TOKENS) and model.merges == []


def test_pair_counts(spark):
    texts = ["a\U0001f600b", "aaaa", "aaaa", "x", ""]
    counts = bpe.pair_counts(bpe.distinct_texts(corpus(spark, texts)))
    assert rows(bpe.pair_counts(corpus(spark, texts))) == rows(counts)
    assert dict(rows(counts)) == {"a\U0001f600": 1, "\U0001f600b": 1, "aa": 6}
    assert bpe.top_pairs(counts, 1).first()["pair"] == "aa"


def nested_model():
    """A product made by two merges, of which the later one enables an earlier merge."""
    merges = [("b", "c"), ("ab", "c"), ("a", "a"), ("abc", "a"), ("aa", "aa"), ("a", "b"), ("a", "bc")]
    tokens = [*SPECIAL_TOKENS, *"abc", "bc", "ab", "abc", "aa", "abca", "aaaa"]
    ids = {t: i for i, t in enumerate(tokens)}
    return bpe.BpeModel(tokens, [(ids[a], ids[b], ids[a + b]) for a, b in merges]).extended()


@pytest.fixture(scope="module")
def trained(spark):
    return bpe.train_bpe(corpus(spark, proteins(21)), vocab_size=100).extended()


@pytest.mark.parametrize("kind", ["nested", "trained"])
def test_encoding_matches_the_library(spark, trained, kind):
    rng = random.Random(7)
    model = nested_model() if kind == "nested" else trained
    alphabet = "abcabcabc?\U0001f600" if kind == "nested" else RESIDUES + "xz"
    pieces = [*alphabet, "[BOS]", "[EOS]", "<fim_middle>", "<fim_prefix>", "[UNK]", "<fim_", "[BOS"]
    texts = ["", "[BOS]", "a" * 31, "[BO", "S]"] + [
        "".join(rng.choices(pieces, weights=[6] * len(alphabet) + [1] * 7, k=rng.randint(1, 90))) for _ in range(150)
    ]
    texts.append("".join(rng.choices(alphabet, k=5000)))
    tok = Tokenizer.from_str(model.to_json())
    got = {r["id"]: r for r in bpe.tokenize(corpus(spark, texts), model).collect()}
    for i, text in enumerate(texts):
        want = tok.encode(text)
        row = got[str(i)]
        assert row["input_ids"] == want.ids, text
        assert list(zip(row["starts"], row["ends"])) == want.offsets, text


def test_small_steps_and_batches_do_not_matter(spark, trained, monkeypatch):
    texts = proteins(31, n=40)
    model = trained
    want = rows(bpe.tokenize(corpus(spark, texts), model))
    monkeypatch.setattr(bpe, "CHARS_PER_STEP", 50)
    assert rows(bpe.tokenize(corpus(spark, texts).repartition(3), model)) == want


def test_offsets_slice_back(spark, trained):
    model = trained
    for rate in (0.0, 0.3, 1.0):
        for r in bpe.tokenize(corpus(spark, proteins(41, n=20)), model, dropout=rate, seed=3).collect():
            pieces = [r["text"][s:e] for s, e in zip(r["starts"], r["ends"])]
            assert "".join(pieces) == r["text"]
            assert [model.tokens[i] for i in r["input_ids"]] == pieces
            assert rate < 1.0 or all(len(p) == 1 for p in pieces)


def plain_dropout(text, key, rate, t):
    """Rounds over lists: the lowest rank first, from the left, each place drawn once a round."""
    sym, start, stop, _ = (a.tolist() for a in bpe_kernel._symbols([text], t))
    rank_of = dict(zip(t.pair_keys.tolist(), t.pair_ranks.tolist()))
    draw = bpe_kernel.Dropout(rate, bpe_kernel.text_keys(1, [key]))
    round_no, merged = 0, True
    while merged:
        merged = False
        while True:
            found = []
            for i in range(len(sym) - 1):
                r = rank_of.get(sym[i] * t.n_tokens + sym[i + 1])
                if r is not None and not draw.passed(np.array([0]), np.array([start[i]]), r, round_no)[0]:
                    found.append((r, i))
            if not found:
                break
            r, i = min(found)
            sym[i:i + 2], stop[i:i + 2] = [int(t.product[r])], [stop[i + 1]]
            del start[i + 1]
            merged = True
        round_no += 1
    return sym, start, stop


def flat_dropout(texts, keys, rate, t):
    return bpe_kernel.encode(texts, t, bpe_kernel.Dropout(rate, bpe_kernel.text_keys(1, keys)))


@pytest.mark.parametrize("rate", [0.0, 0.2, 0.6, 1.0])
def test_dropout_equals_a_plain_loop(spark, rate):
    tables = nested_model().tables()
    rng = random.Random(2)
    texts = ["", "a", "ababab", "aaaaaaa", *("".join(rng.choices("abc", k=rng.randint(0, 40))) for _ in range(80))]
    keys = [str(i) for i in range(len(texts))]
    ids, starts, ends, counts = flat_dropout(texts, keys, rate, tables)
    at = 0
    for text, key, n in zip(texts, keys, counts):
        part = [v[at:at + n].tolist() for v in (ids, starts, ends)]
        at += n
        assert part == list(plain_dropout(text, key, rate, tables))
        # Other texts of the batch change nothing.
        assert part == [v.tolist() for v in flat_dropout([text], [key], rate, tables)[:3]]
    if rate == 0.0:
        assert [v.tolist() for v in bpe_kernel.encode(texts, tables)] == [v.tolist() for v in (ids, starts, ends, counts)]


def test_dropout_draws():
    tables = nested_model().tables()
    sizes = [np.mean([len(flat_dropout(["abcab" * 30], [str(k)], p, tables)[0]) for k in range(30)]) for p in (0.0, 0.5, 0.9, 1.0)]
    assert sizes == sorted(sizes) and sizes[-1] == 150
    draw = bpe_kernel.Dropout(0.3, bpe_kernel.text_keys(1, ["x"]))
    shares = [draw.passed(np.zeros(20_000, int), np.arange(20_000), 5, r).mean() for r in (0, 1)]
    assert all(abs(s - 0.3) < 0.02 for s in shares)


def test_known_protein_round_trip(spark, trained):
    model = trained
    row = bpe.tokenize(corpus(spark, [GFP]), model).select(bpe.detokenize(F.col("input_ids"), model).alias("d")).first()
    assert row["d"].replace(" ", "") == GFP and " " in row["d"]
    wrapped = bpe.tokenize(corpus(spark, [f"[BOS]{GFP}[EOS]"]), model)
    assert wrapped.select(bpe.example_text(F.col("input_ids"), model)).first()[0] == f"[BOS]{GFP}[EOS]"


def test_score(spark):
    model = nested_model()
    score = bpe.tokenizer_score(bpe.tokenize(corpus(spark, ["ab?", "c"]), model), model.ids["[UNK]"]).first()
    assert (score["total_tokens"], score["total_chars"], score["unk_tokens"]) == (3, 4, 1)
    assert score["tokens_per_char"] == 0.75 and score["unk_rate"] == pytest.approx(100 / 3)
    empty = bpe.tokenizer_score(bpe.tokenize(corpus(spark, []), model), 0).first()
    assert (empty["tokens_per_char"], empty["unk_rate"]) == (0.0, 0.0)


def test_model_files(spark, tmp_path):
    model = nested_model()
    bpe.BpeModel.save(model, spark, str(tmp_path / "m"))
    assert bpe.BpeModel.load(spark, str(tmp_path / "m")) == model
    assert [r["token"] for r in model.vocab(spark).orderBy("token_id").collect()] == model.tokens
    assert model.merge_table(spark).orderBy("rank").first()[1:] == ("b", "c")
    write_vocab(model.vocab(spark), str(tmp_path / "v"))
    assert rows(read_vocab(spark, str(tmp_path / "v"))) == rows(model.vocab(spark))


def test_vocab_with_tabs_and_line_feeds(spark, tmp_path):
    tokens = ["a", "\t", "\n", "a\tb\n", "\\", "\\n", "\\\n", "\\\\n\t7", "\n\n\\", ""]
    vocab = spark.createDataFrame(list(zip(tokens, range(10))), "token string, token_id int")
    write_vocab(vocab, str(tmp_path / "v"))
    assert rows(read_vocab(spark, str(tmp_path / "v"))) == rows(vocab)


def test_vocab_tables(spark):
    tokens = spark.createDataFrame([(t,) for t in "b a a c b AX [X] X [UNK]".split()], "token string")
    table = vocab.ranked_vocab(tokens, SPECIAL_TOKENS)
    ids = dict(rows(table))
    assert [ids[t] for t in ("[UNK]", "[EOS]", "a", "b", "AX")] == [0, 6, 7, 8, 9]
    assert {r["token"] for r in vocab.vocab_suppress(table).collect()} == {"X", "AX"}
    assert vocab.max_token_chars(table, SPECIAL_TOKENS).first()[0] == 3
    top = max(ids.values())
    more = vocab.vocab_extend(table, ["a", "<t>", "<u>"])
    assert {t: i for t, i in rows(more) if i > top or t == "a"} == {"a": 7, "<t>": top + 1, "<u>": top + 2}


def test_prepare_labels_and_prefix(spark):
    model = nested_model()
    df = corpus(spark, ["abcabc" * 4, "cab", ""])
    out = prepare_corpus(df, model, seed=1, fim_rate=1.0, fim_sft_style=True, max_length=15, prefix="x_").collect()
    middle = model.ids["<fim_middle>"]
    for r in out:
        ids, labels = r["x_input_ids"], r["x_labels"]
        assert len(ids) == len(labels) == len(r["x_attention_mask"]) == len(r["x_offset_mapping"])
        assert r["is_fim"] == (middle in ids)
        cut = ids.index(middle) + 1 if r["is_fim"] else 0
        assert labels == [-100] * cut + ids[cut:]
    prompt = prepare_corpus(df, model, seed=1, generate=True)
    assert "labels" not in prompt.columns


def test_a_step_takes_bounded_memory():
    """Millions of characters in one batch are encoded in small steps."""
    batch = pa.RecordBatch.from_pydict({"text": ["the chen " * 20_000] * 20 + [None]})
    tables, n_chars = fixed_model().tables(), 0
    tracemalloc.start()
    try:
        for part in bpe._steps(batch, "text"):
            texts = [t or "" for t in part.column("text").to_pylist()]
            n_chars += sum(map(len, texts))
            bpe.encode(texts, tables)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n_chars == 3_600_000 and peak < 100e6


def test_dropout_query_carries_few_arrays(spark, tmp_path, monkeypatch):
    """What goes into each tokenizing step: the texts, and at most one array to compare with."""
    docs = [(i, f"the end of {i}\t ", "en", "s", 0) for i in range(9)] + [(9, None, "en", "s", 0), (10, "", "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(str(tmp_path / "documents.parquet"))
    carried, plain = [], bpe.tokenize

    def recorded(df, *args, **options):
        carried.append(sum(kind.startswith("array") for _, kind in df.dtypes))
        return plain(df, *args, **options)

    monkeypatch.setattr(bpe, "tokenize", recorded)
    got = QUERIES["bpe_tokenize_dropout"](spark, str(tmp_path)).collect()
    assert len(carried) == 4 and max(carried) <= 1
    assert all(r.spelled and r.none_dropped and r.all_dropped == r.n_chars for r in got if r.id != "9") and len(got) == 11

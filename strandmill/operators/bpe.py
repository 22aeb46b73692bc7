"""BPE vocabularies: pair counts, training, application, scoring, decoding."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from strandmill.functions.fim import FIM_TAGS
from strandmill.functions.text import SPECIAL_TOKENS, UNK
from strandmill.operators.bpe_index import PairIndex, bucket_number
from strandmill.operators.bpe_kernel import (
    Dropout, EncoderTables, build_tables, encode, replace_all, text_keys, weighted_pairs,
)
from strandmill.session import materialize, scratch, two_paths

# Characters encoded together in one task step; arrays over them take some hundred bytes each.
CHARS_PER_STEP = 500_000
# Best pairs looked at per training pass, and merges applied before the corpus is rewritten.
PAIRS_PER_PASS = 64
MERGES_PER_REWRITE = 16
# Texts are indexed by their pairs once a pass merges fewer pairs than this share of the texts.
INDEX_SHARE = 0.25
# While training, token i is written as one character from here on, leaving out surrogates.
FIRST_CODE = 0x100
MAX_TOKENS = 0x110000 - 0x800 - FIRST_CODE


@dataclass(frozen=True)
class BpeModel:
    """A vocabulary (token by id), merges by rank as (left, right, product), special tokens."""

    tokens: list[str]
    merges: list[tuple[int, int, int]]
    specials: list[str] = field(default_factory=lambda: list(SPECIAL_TOKENS))
    unk: str = UNK

    @cached_property
    def ids(self) -> dict[str, int]:
        return {t: i for i, t in enumerate(self.tokens)}

    def extended(self, extra=FIM_TAGS) -> BpeModel:
        """The model with more special tokens; those it has keep their ids."""
        new = [t for t in extra if t not in self.ids]
        special = [t for t in extra if t not in self.specials]
        return BpeModel(self.tokens + new, self.merges, self.specials + special, self.unk)

    def tables(self) -> EncoderTables:
        specials = [(s, self.ids[s]) for s in self.specials]
        return build_tables(self.tokens, self.merges, specials, self.ids[self.unk])

    def to_json(self) -> str:
        added = [
            {"id": self.ids[s], "content": s, "single_word": False, "lstrip": False,
             "rstrip": False, "normalized": False, "special": True}
            for s in self.specials
        ]
        model = {
            "type": "BPE", "dropout": None, "unk_token": self.unk,
            "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False,
            "byte_fallback": False, "ignore_merges": False, "vocab": self.ids,
            "merges": [[self.tokens[a], self.tokens[b]] for a, b, _ in self.merges],
        }
        return json.dumps({
            "version": "1.0", "truncation": None, "padding": None, "added_tokens": added,
            "normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None,
            "model": model,
        }, ensure_ascii=False)

    @staticmethod
    def from_json(text: str) -> BpeModel:
        data = json.loads(text)
        ids = dict(data["model"]["vocab"])
        for added in data["added_tokens"]:
            ids.setdefault(added["content"], added["id"])
        tokens = [t for t, _ in sorted(ids.items(), key=lambda item: item[1])]
        pairs = [
            tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m)
            for m in data["model"]["merges"]
        ]
        merges = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
        specials = [a["content"] for a in data["added_tokens"] if a["special"]]
        return BpeModel(tokens, merges, specials, data["model"]["unk_token"])

    def save(self, spark, path: str) -> None:
        """Write the vocabulary file as one row of a text folder; its size is the vocabulary's."""
        spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.text(path)

    @staticmethod
    def load(spark, path: str) -> BpeModel:
        return BpeModel.from_json(spark.read.option("wholetext", True).text(path).first()["value"])

    def vocab(self, spark) -> DataFrame:
        rows = list(enumerate(self.tokens))
        return spark.createDataFrame(rows, "token_id int, token string").select("token", "token_id")

    def merge_table(self, spark) -> DataFrame:
        rows = [(r, self.tokens[a], self.tokens[b]) for r, (a, b, _) in enumerate(self.merges)]
        return spark.createDataFrame(rows, "rank int, left string, right string")


def _steps(batch: pa.RecordBatch, text: str, limit: int | None = None):
    """Slices of a batch with a bounded number of characters, at least one text each."""
    limit = limit or CHARS_PER_STEP
    sizes = pc.fill_null(pc.utf8_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


# ---------------------------------------------------------------- pair counts and training


def distinct_texts(corpus: DataFrame, text: str = "text") -> DataFrame:
    """Each text once with its number of copies; all later work is per distinct text."""
    return corpus.filter(F.col(text) != "").groupBy(F.col(text).alias("text")).agg(
        F.count(F.lit(1)).alias("copies")
    )


def pair_counts(words: DataFrame, text: str = "text") -> DataFrame:
    """Occurrences of every neighbouring pair: ``pair, cnt``. Runs count every neighbour.

    Rows count as often as a column ``copies`` says, or once. Texts are counted where they are
    read; only counts are shuffled.
    """
    copies = F.col("copies").cast("bigint") if "copies" in words.columns else F.lit(1).cast("bigint")
    rows = words.filter(F.col(text) != "").select(F.col(text).alias("text"), copies.alias("copies"))
    return _coded_pair_counts(rows, [])


def top_pairs(counts: DataFrame, limit: int) -> DataFrame:
    """The most frequent pairs; ties go to the pair that sorts first."""
    return counts.orderBy(F.desc("cnt"), F.asc("pair")).limit(limit)


def _code(token_id: int) -> str:
    point = FIRST_CODE + token_id
    return chr(point if point < 0xD800 else point + 0x800)


def _token_id(char: str) -> int:
    point = ord(char)
    return (point if point < 0xD800 else point - 0x800) - FIRST_CODE


def _safe_prefix(
    ranking: list[tuple[int, int, int]], full: bool, tokens: list[str], ids: dict[str, int]
) -> list[tuple[int, int]]:
    """How many of the best pairs can be merged in one pass with the same result as one by one.

    A merge changes counts only of pairs that share a symbol with it, and a pair it creates
    occurs no more often than such a pair does. So the best pairs may go together as long as
    their symbols differ and each is strictly more frequent than the first pair left out.
    A pair of equal symbols, or one whose product is a known token, goes alone.
    """
    taken: list[tuple[int, int, int]] = []
    symbols: set[int] = set()
    products: set[str] = set()
    floor = ranking[-1][2] if full else 0
    for a, b, cnt in ranking:
        product = tokens[a] + tokens[b]
        alone = a == b or product in ids
        if taken and (alone or product in products or a in symbols or b in symbols):
            floor = cnt
            break
        if alone:
            return [(a, b)]
        taken.append((a, b, cnt))
        symbols |= {a, b}
        products.add(product)
    return [(a, b) for i, (a, b, cnt) in enumerate(taken) if i == 0 or cnt > floor]


def _replaced(text: Column, merges: list[tuple[int, int, int]]) -> Column:
    """Coded text after the merges. Replacing goes from the left, as merging a run does."""
    for a, b, new in merges:
        text = F.replace(text, F.lit(_code(a) + _code(b)), F.lit(_code(new)))
    return text


def _coded_pair_counts(words: DataFrame, pending: list[tuple[int, int, int]]) -> DataFrame:
    """As ``pair_counts`` for coded texts to which the pending merges still have to be applied.
    Runs in Arrow batches."""
    merges = [(_code(x) + _code(y), _code(new)) for x, y, new in pending]

    def task(batches):
        for record in batches:
            for part in _steps(record, "text"):
                texts, copies = part.column("text").to_pylist(), part.column("copies").to_numpy()
                pairs, cnt = weighted_pairs(replace_all(texts, merges), copies)
                yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.string()), pa.array(cnt)], ["pair", "cnt"])

    counted = words.select("text", "copies").mapInArrow(task, "pair string, cnt bigint")
    return counted.groupBy("pair").agg(F.sum("cnt").alias("cnt"))


def _short_pairs(counts: DataFrame, tokens: list[str], max_token_length: int) -> DataFrame:
    """Pairs whose product is short enough; the joined table has one row per token."""
    sizes = F.broadcast(counts.sparkSession.createDataFrame(
        [(_code(i), len(t)) for i, t in enumerate(tokens)], "code string, n int"
    ))
    first = counts.withColumn("code", F.substring("pair", 1, 1)).join(sizes, "code")
    both = first.withColumnRenamed("n", "n1").withColumn("code", F.substring("pair", 2, 1)).join(sizes, "code")
    size = F.col("n1") + F.col("n")
    # The public trainer bounds longer tokens strictly and lets two characters pass.
    return both.filter((size < max_token_length) | (size == 2)).select("pair", "cnt")


def train_bpe(
    corpus: DataFrame, vocab_size: int = 30_000, min_frequency: int = 0,
    max_token_length: int | None = None, text: str = "text",
    specials: tuple[str, ...] = SPECIAL_TOKENS, buckets: int | None = None,
) -> BpeModel:
    """Learn a vocabulary; a whole text is one word.

    Every token is one character of a coded text, so a merge is a literal replacement. A pass
    makes all merges that cannot influence each other. While merges touch many texts, a pass
    counts all pairs anew, and the coded corpus is rewritten from time to time. Once they are rare,
    texts are put into ``buckets`` with an index of their pairs, and a pass reads only the buckets
    that hold what it merges. Only counts are shuffled, and the driver only holds the vocabulary
    and the places of the buckets. Tables are deleted at the end.
    """
    if vocab_size > MAX_TOKENS:
        raise ValueError(f"vocab_size must not exceed {MAX_TOKENS}")
    with scratch(corpus.sparkSession):
        return _train(corpus, vocab_size, max(1, min_frequency), max_token_length, text, specials, buckets)


def _train(
    corpus: DataFrame, vocab_size: int, min_frequency: int, max_token_length: int | None, text: str,
    specials: tuple[str, ...], buckets: int | None,
) -> BpeModel:
    spark = corpus.sparkSession
    # Every pass is heavy on CPU per byte, so the texts are laid out in no fewer files than cores.
    tasks = max(
        spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    )
    words = materialize(distinct_texts(corpus, text).repartition(tasks, "text"), "bpe-texts")
    # Bounded by the number of Unicode characters.
    alphabet = sorted(
        r[0] for r in words.select(F.explode(F.array_distinct(F.split("text", "")))).distinct()
        .collect()
    )
    tokens = list(specials) + [c for c in alphabet if c not in specials]
    ids = {t: i for i, t in enumerate(tokens)}
    merges: list[tuple[int, int, int]] = []
    if not alphabet:
        return BpeModel(tokens, merges, list(specials))
    total_copies, chars = words.agg(F.sum("copies"), F.sum(F.length("text"))).first()
    coded = F.translate("text", "".join(alphabet), "".join(_code(ids[c]) for c in alphabet))
    texts_at = two_paths(spark, "bpe-coded")
    state = materialize(words.select(coded.alias("text"), "copies"), path=next(texts_at))
    pending: list[tuple[int, int, int]] = []
    index: PairIndex | None = None

    while len(tokens) < vocab_size:
        counts = _coded_pair_counts(state, pending) if index is None else index.counts()
        eligible = counts.filter(F.col("cnt") >= min_frequency)
        if max_token_length is not None:
            eligible = _short_pairs(eligible, tokens, max_token_length)
        best = [
            (_token_id(r["pair"][0]), _token_id(r["pair"][1]), r["cnt"])
            for r in top_pairs(eligible, PAIRS_PER_PASS).collect()
        ]
        if not best:
            break
        batch = []
        for a, b in _safe_prefix(best, len(best) == PAIRS_PER_PASS, tokens, ids):
            if len(tokens) >= vocab_size:
                break
            product = tokens[a] + tokens[b]
            if product not in ids:
                ids[product] = len(tokens)
                tokens.append(product)
            batch.append((a, b, ids[product]))
        merges += batch
        if index is None and sum(cnt for _, _, cnt in best[: len(batch)]) < INDEX_SHARE * total_copies:
            current = state.select(_replaced(F.col("text"), pending).alias("text"), "copies")
            index = PairIndex(current, buckets or bucket_number(chars, tasks))
        if index is not None:
            index.merge([(_code(a) + _code(b), _code(new)) for a, b, new in batch])
            continue
        pending += batch
        if len(pending) >= MERGES_PER_REWRITE:
            merged = _replaced(F.col("text"), pending).alias("text")
            state = materialize(state.select(merged, "copies"), path=next(texts_at))
            pending = []
    return BpeModel(tokens, merges, list(specials))


# ---------------------------------------------------------------- application


def _int_lists(counts, values: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(counts))).astype("int32")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype("int32")))


def tokenize(
    df: DataFrame, model: BpeModel, text: str = "text", key: str = "id",
    dropout: float = 0.0, seed: int = 0,
) -> DataFrame:
    """Add ``input_ids``, ``starts`` and ``ends`` (character offsets) for every text.

    Special tokens stay whole and unknown characters become one unknown token each. With
    ``dropout``, merges are passed over at that rate, by draws from seed and ``key``. The tables
    broadcast to the tasks grow with the vocabulary, not with the data.
    """
    # Broadcast as plain fields: a broadcast object needs its class installed on the executors.
    fields = df.sparkSession.sparkContext.broadcast(dict(vars(model.tables())))

    def run(texts: list[str], keys: list[str], t: EncoderTables) -> list[pa.Array]:
        passed_over = Dropout(dropout, text_keys(seed, keys)) if dropout else None
        ids, starts, ends, counts = encode(texts, t, passed_over)
        return [_int_lists(counts, v) for v in (ids, starts, ends)]

    def task(batches):
        tables = EncoderTables(**fields.value)
        for batch in batches:
            for part in _steps(batch, text):
                texts = [x or "" for x in part.column(text).to_pylist()]
                keys = part.column(key).cast(pa.string()).to_pylist() if dropout else []
                lists = run(texts, keys, tables)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *lists], [*part.schema.names, "input_ids", "starts", "ends"]
                )

    ints = ArrayType(IntegerType())
    schema = StructType(
        df.schema.fields + [StructField(c, ints) for c in ("input_ids", "starts", "ends")]
    )
    return df.mapInArrow(task, schema)


def token_names(ids: Column, model: BpeModel) -> Column:
    """Array of tokens for an array of ids; the vocabulary is one folded constant."""
    names = F.from_json(F.lit(json.dumps(model.tokens)), "array<string>")
    return F.transform(ids, lambda i: names[i])


def detokenize(ids: Column, model: BpeModel, skip_special: bool = True) -> Column:
    """Tokens joined by a space; special tokens are left out unless asked for."""
    names = token_names(ids, model)
    if skip_special:
        special = F.array(*[F.lit(s) for s in model.specials])
        names = F.filter(names, lambda t: ~F.array_contains(special, t))
    return F.array_join(names, " ")


def example_text(ids: Column, model: BpeModel) -> Column:
    """Decoded text without spaces, special tokens kept."""
    return F.replace(detokenize(ids, model, skip_special=False), F.lit(" "), F.lit(""))


def tokenizer_score(tokenized: DataFrame, unk_id: int, text: str = "text") -> DataFrame:
    """Totals, tokens per character and the share of unknown tokens in percent."""
    unknown = F.size(F.filter("input_ids", lambda i: i == unk_id))
    totals = tokenized.agg(
        F.coalesce(F.sum(F.size("input_ids")), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("total_chars"),
        F.coalesce(F.sum(unknown), F.lit(0)).alias("unk_tokens"),
    )
    tokens, chars, unk = F.col("total_tokens"), F.col("total_chars"), F.col("unk_tokens")
    # Called tokens per word where it is printed, but the divisor is characters.
    return totals.withColumn(
        "tokens_per_char", F.when(chars > 0, tokens / chars).otherwise(0.0)
    ).withColumn("unk_rate", F.when(tokens > 0, unk / tokens * 100).otherwise(0.0))


# The printed lines of a score.
TOKENS_LINE, UNK_LINE = "Tokens per Word: %.2f", "UNK Token Rate:  %.2f%%"


def score_lines(score: DataFrame) -> DataFrame:
    """The two printed lines of a score, with two decimals."""
    return score.select(
        F.format_string(TOKENS_LINE, "tokens_per_char").alias("tokens_line"),
        F.format_string(UNK_LINE, "unk_rate").alias("unk_line"),
    )

"""Vocabularies, BPE, token ids, labels, padding and the whole training transform."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmill.functions.fim import FIM_TAGS
from strandmill.functions.text import SPECIAL_TOKENS
from strandmill.operators import bpe, labels, vocab
from strandmill.operators.batches import fold_batch_plan, latest_by_suffix
from strandmill.operators.bpe import BpeModel
from strandmill.operators.rowid import with_row_id
from strandmill.plans.catalog.registry import (
    DOCS_SQL, SEED, docs, query, sql_arranged, table,
)
from strandmill.plans.prepare import prepare_corpus
from strandmill.session import fresh_path
from strandmill.sources.writers import read_vocab, write_vocab

# ---------------------------------------------------------------- word vocabularies

_SPLIT = "[ \\t\\n\\r\\f]+"


def _words(df):
    return df.select(F.explode(F.split("text", _SPLIT)).alias("token")).filter("token <> ''")


def _vocab(spark, sf_dir):
    return vocab.ranked_vocab(_words(docs(spark, sf_dir)), SPECIAL_TOKENS)


_SPECIAL_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS token, {i} AS token_id" for i, t in enumerate(SPECIAL_TOKENS)
)
_SPECIAL_LIST = ", ".join(f"'{t}'" for t in SPECIAL_TOKENS)
_WORDS_SQL = f"""
    SELECT token FROM (SELECT unnest(regexp_split_to_array(text, '{_SPLIT}')) AS token FROM documents)
    WHERE token <> ''
"""
_VOCAB_SQL = f"""
    SELECT token, CAST(token_id AS INTEGER) AS token_id FROM (
      {_SPECIAL_SQL} UNION ALL
      SELECT token, row_number() OVER (ORDER BY n DESC, token) + {len(SPECIAL_TOKENS) - 1} FROM (
        SELECT token, count(*) AS n FROM ({_WORDS_SQL}) WHERE token NOT IN ({_SPECIAL_LIST}) GROUP BY token))
"""


@query("vocab_table", _VOCAB_SQL)
def vocab_table(spark, sf_dir):
    path = fresh_path(spark, "vocab")
    write_vocab(_vocab(spark, sf_dir), path)
    return read_vocab(spark, path)


@query("vocab_extend", f"""
    WITH v AS ({_VOCAB_SQL})
    SELECT token, token_id FROM v UNION ALL
    SELECT t.token, CAST((SELECT max(token_id) FROM v) + t.k AS INTEGER) FROM (
      VALUES ('{FIM_TAGS[0]}', 1), ('{FIM_TAGS[1]}', 2), ('{FIM_TAGS[2]}', 3)) t(token, k)
""")
def vocab_extend(spark, sf_dir):
    return vocab.vocab_extend(_vocab(spark, sf_dir))


@query("vocab_suppress", f"""
    SELECT token, token_id FROM ({_VOCAB_SQL}) WHERE token LIKE '%X%' AND token NOT LIKE '[%'
""")
def vocab_suppress(spark, sf_dir):
    return vocab.vocab_suppress(_vocab(spark, sf_dir))


@query("max_token_chars", f"""
    SELECT CAST(max(length(token)) AS INTEGER) AS max_token_chars FROM ({_VOCAB_SQL})
    WHERE token NOT IN ({_SPECIAL_LIST})
""")
def max_token_chars(spark, sf_dir):
    return vocab.max_token_chars(_vocab(spark, sf_dir), SPECIAL_TOKENS)


def _turn_tokens(spark, sf_dir):
    tokens = F.filter(F.split("text", _SPLIT), lambda t: t != "")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tokens.alias("tokens"))


_TURNS_SQL = f"""
    SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '{_SPLIT}'), lambda t: t <> '') AS tokens
    FROM conversations
"""
_TURN_TOKENS_SQL = f"""
    SELECT conv_id, turn, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS pos FROM ({_TURNS_SQL})
"""


@query("token_ids", f"""
    SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, coalesce(token_id, 0) AS token_id
    FROM ({_TURN_TOKENS_SQL}) LEFT JOIN ({_VOCAB_SQL}) USING (token)
""")
def token_ids(spark, sf_dir):
    """Words of the conversations in the vocabulary of the documents."""
    tokens = _turn_tokens(spark, sf_dir).select(
        "conv_id", "turn", F.posexplode("tokens").alias("pos", "token")
    )
    return labels.token_ids(tokens, _vocab(spark, sf_dir), ["conv_id", "turn", "pos"], 0).drop("token")


@query("token_offsets", f"""
    SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos,
           CAST(tok_end - length(token) AS INTEGER) AS tok_start, CAST(tok_end AS INTEGER) AS tok_end
    FROM (SELECT *, sum(length(token)) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS tok_end
          FROM ({_TURN_TOKENS_SQL}))
""")
def token_offsets(spark, sf_dir):
    return _turn_tokens(spark, sf_dir).select(
        "conv_id", "turn", F.posexplode(labels.token_offsets(F.col("tokens"))).alias("pos", "span")
    ).select("conv_id", "turn", "pos", F.col("span.start").alias("tok_start"), F.col("span.end").alias("tok_end"))


# ---------------------------------------------------------------- labels and padding

# Stand-in ids: the length of each word. 7 plays the middle tag, 0 the padding.
MIDDLE, PAD_ID = 7, 0


def _padded(spark, sf_dir):
    rows = _turn_tokens(spark, sf_dir).select(
        "conv_id", "turn", F.transform("tokens", F.length).alias("ids")
    )
    return labels.pad_batches(rows, "conv_id", "ids", PAD_ID)


def _joined(column):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), " ")


_IDS_SQL = f"SELECT conv_id, turn, list_transform(tokens, lambda t: length(t)) AS ids FROM ({_TURNS_SQL})"
_PADDED_SQL = f"""
    SELECT conv_id, turn,
           list_concat(ids, list_transform(range(longest - len(ids)), lambda i: {PAD_ID}::BIGINT)) AS ids,
           list_concat(list_transform(ids, lambda i: 1), list_transform(range(longest - len(ids)), lambda i: 0)) AS mask
    FROM (SELECT *, max(len(ids)) OVER (PARTITION BY conv_id) AS longest FROM ({_IDS_SQL}))
"""
_LABELS_SQL = f"""
    SELECT conv_id, turn, list_transform(list_zip(ids, mask),
           lambda z: CASE WHEN z[2] > 0 THEN z[1] ELSE -100 END) AS labels FROM ({_PADDED_SQL})
"""


@query("pad_batches", f"""
    SELECT conv_id, turn, array_to_string(ids, ' ') AS ids, array_to_string(mask, ' ') AS attention_mask
    FROM ({_PADDED_SQL})
""")
def pad_batches(spark, sf_dir):
    return _padded(spark, sf_dir).select(
        "conv_id", "turn", _joined(F.col("ids")).alias("ids"),
        _joined(F.col("attention_mask")).alias("attention_mask"),
    )


@query("labels", f"SELECT conv_id, turn, array_to_string(labels, ' ') AS labels FROM ({_LABELS_SQL})")
def labels_query(spark, sf_dir):
    plain = labels.labels(F.col("ids"), F.col("attention_mask"))
    return _padded(spark, sf_dir).select("conv_id", "turn", _joined(plain).alias("labels"))


@query("sft_labels", f"""
    SELECT conv_id, turn, array_to_string(list_transform(labels, lambda x, i:
           CASE WHEN coalesce(list_position(labels, {MIDDLE}), 0) > 0 AND i > list_position(labels, {MIDDLE})
           THEN x ELSE -100 END), ' ') AS labels
    FROM ({_LABELS_SQL})
""")
def sft_labels(spark, sf_dir):
    plain = labels.labels(F.col("ids"), F.col("attention_mask"))
    rows = _padded(spark, sf_dir).withColumn("plain", plain)
    return rows.select("conv_id", "turn", _joined(labels.sft_labels(F.col("plain"), MIDDLE)).alias("labels"))


# ---------------------------------------------------------------- batch plan, latest path


@query("fold_batch_plan", """
    WITH numbered AS (
      SELECT conv_id, turn, length(text) AS n, row_number() OVER (ORDER BY conv_id, turn) - 1 AS row_id
      FROM conversations),
    chunked AS (
      SELECT *, row_id // 8 * 8 AS chunk_start, max(n) OVER (PARTITION BY row_id // 8) AS max_length,
             count(*) OVER (PARTITION BY row_id // 8) AS rows FROM numbered),
    sized AS (
      SELECT *, CASE WHEN rows = 1 THEN 8 WHEN max_length > 700 THEN 1 WHEN max_length > 500 THEN 2
             WHEN max_length > 200 THEN 4 ELSE 8 END AS batch_size FROM chunked)
    SELECT conv_id, turn, chunk_start, CAST(max_length AS INTEGER) AS max_length,
           CAST(batch_size AS INTEGER) AS batch_size,
           CAST((row_id - chunk_start) // batch_size AS INTEGER) AS sub_batch,
           'esm_' || (row_id - chunk_start + 1) || '.pdb_esm_0_' || chunk_start || '.pdb' AS out_name
    FROM sized
""")
def fold_batch_plan_query(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("length"))
    numbered = with_row_id(rows, ["conv_id", "turn"]).withColumn("file_ord", F.lit(0))
    return fold_batch_plan(numbered).drop("length", "row_id", "file_ord")


@query("latest_by_suffix", """
    SELECT run, 'run-' || run || '/checkpoint-' || max(o_orderkey) AS path FROM (
      SELECT o_custkey AS run, o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY run
""")
def latest_by_suffix_query(spark, sf_dir):
    """Pending orders stand for paths without a number, which are ignored."""
    number = F.when(F.col("o_orderstatus") == "P", "x").otherwise(F.col("o_orderkey").cast("string"))
    paths = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("run"),
        F.concat(F.lit("run-"), F.col("o_custkey").cast("string"), F.lit("/checkpoint-"), number).alias("path"),
    )
    return latest_by_suffix(paths, by=["run"])


# ---------------------------------------------------------------- BPE

# The alphabet and merges of the vocabulary used below, merges by rank.
ALPHABET = " ,.abcdefghijklmnopqrstuvwxyz"
MERGES = (
    ("e", "r"), ("t", "h"), ("i", "n"), ("e", "n"), ("a", "n"), ("o", "n"), ("r", "e"),
    ("e", "e"), ("l", "l"), ("th", "e"), ("in", "g"), ("an", "d"), ("t", "i"), ("ti", "on"),
    ("o", "u"), ("e", " "), ("s", "t"), ("er", " "), ("ee", "ee"), ("the", " "), ("ing", " "),
    ("u", "e"), ("l", "e"), ("c", "h"), ("ch", "en"),
)


def fixed_model() -> BpeModel:
    tokens = [*SPECIAL_TOKENS, *ALPHABET, *[a + b for a, b in MERGES]]
    ids = {t: i for i, t in enumerate(tokens)}
    return BpeModel(tokens, [(ids[a], ids[b], ids[a + b]) for a, b in MERGES]).extended()


_MODEL = fixed_model()
_BASE = 0xE000


def _char(token: str) -> str:
    return f"chr({_BASE + _MODEL.ids[token]})"


def _coded_sql(text: str) -> str:
    """The text with one private character per token: specials, unknowns, then all merges."""
    coded = text
    for token in _MODEL.specials:
        coded = f"replace({coded}, '{token}', {_char(token)})"
    codes = " || ".join(_char(c) for c in ALPHABET)
    coded = f"translate({coded}, '{ALPHABET}', {codes})"
    coded = f"regexp_replace({coded}, '[^\\x{{E000}}-\\x{{E0FF}}]', {_char('[UNK]')}, 'g')"
    for a, b in MERGES:
        coded = f"replace({coded}, {_char(a)} || {_char(b)}, {_char(a + b)})"
    return coded


def _ids_sql(coded: str) -> str:
    return f"list_transform(string_split({coded}, ''), lambda c: unicode(c) - {_BASE})"


_NAMES_SQL = "[" + ", ".join(f"'{t}'" for t in _MODEL.tokens) + "]"


@query("bpe_tokenize", f"""
    WITH t AS (SELECT id, {_ids_sql('coded')} AS ids FROM (SELECT id, {_coded_sql('text')} AS coded FROM ({DOCS_SQL}))),
    e AS (SELECT id, unnest(ids) AS token_id, generate_subscripts(ids, 1) AS pos FROM t),
    s AS (SELECT id, pos, token_id, sum(CASE WHEN token_id = 0 THEN 1 ELSE length(({_NAMES_SQL})[token_id + 1]) END)
          OVER (PARTITION BY id ORDER BY pos) AS stop FROM e)
    SELECT id, string_agg(token_id, ' ' ORDER BY pos) AS input_ids, string_agg(stop, ' ' ORDER BY pos) AS ends
    FROM s GROUP BY id
""")
def bpe_tokenize(spark, sf_dir):
    return bpe.tokenize(docs(spark, sf_dir), fixed_model()).select(
        "id", _joined(F.col("input_ids")).alias("input_ids"), _joined(F.col("ends")).alias("ends")
    )


DROPOUT = 0.3


@query("bpe_tokenize_dropout", """
    SELECT id, length(text) AS n_chars, true AS spelled, length(text) AS all_dropped, true AS none_dropped
    FROM (SELECT CAST(doc_id AS VARCHAR) AS id, translate(text, chr(10) || chr(9) || chr(13), '   ') AS text FROM documents)
""")
def bpe_tokenize_dropout(spark, sf_dir):
    """With dropout, tokens lie end to end and spell the text; without, they are the plain ones;
    if all merges are dropped, every character is one. No text holds a special token."""
    model = fixed_model()
    rows = docs(spark, sf_dir).withColumn("text", F.translate("text", "\n\t\r", "   "))
    # Each result is checked before the next one is made, so only the ids that are compared travel on.
    some = bpe.tokenize(rows, model, dropout=DROPOUT, seed=SEED)
    starts, ends = F.col("starts"), F.col("ends")
    end_to_end = F.concat(F.array(F.lit(0)), ends) == F.concat(starts, F.array(F.length("text")))
    # An unknown token stands for one character, any other for its own text.
    sizes = F.zip_with(starts, ends, lambda a, b: b - a)
    name_sizes = F.transform(bpe.token_names(F.col("input_ids"), model), lambda t: F.when(t == model.unk, 1).otherwise(F.length(t)))
    done = some.select(
        "id", "text", F.coalesce(F.array_max(ends), F.lit(0)).cast("bigint").alias("n_chars"),
        (end_to_end & (sizes == name_sizes)).alias("spelled"),
    )
    dropped = bpe.tokenize(done, model, dropout=1.0, seed=SEED)
    done = dropped.select(*done.columns, F.size("input_ids").cast("bigint").alias("all_dropped"))
    least = bpe.tokenize(done, model, dropout=1e-12, seed=SEED)
    done = least.select(*done.columns, F.col("input_ids").alias("least_ids"))
    plain = bpe.tokenize(done, model)
    return plain.select(
        "id", "n_chars", "spelled", "all_dropped", (F.col("least_ids") == F.col("input_ids")).alias("none_dropped"),
    )


@query("tokenizer_eval", f"""
    WITH t AS (SELECT text, {_coded_sql('text')} AS coded FROM documents),
    s AS (SELECT sum(length(coded)) AS total_tokens, sum(length(text)) AS total_chars,
                 sum(length(coded) - length(replace(coded, {_char('[UNK]')}, ''))) AS unk_tokens FROM t)
    SELECT CAST(total_tokens AS BIGINT) AS total_tokens, CAST(total_chars AS BIGINT) AS total_chars,
           CAST(unk_tokens AS BIGINT) AS unk_tokens,
           round(total_tokens / total_chars, 6) AS tokens_per_char,
           round(unk_tokens / total_tokens * 100, 6) AS unk_rate FROM s
""")
def tokenizer_eval(spark, sf_dir):
    model = fixed_model()
    scored = bpe.tokenizer_score(bpe.tokenize(docs(spark, sf_dir), model), model.ids[model.unk])
    return scored.withColumns(
        {"tokens_per_char": F.round("tokens_per_char", 6), "unk_rate": F.round("unk_rate", 6)}
    )


@query("detokenize", f"""
    SELECT id, array_to_string(list_transform(list_filter({_ids_sql('coded')}, lambda i: i <> 0),
           lambda i: ({_NAMES_SQL})[i + 1]), ' ') AS decoded,
           length(text) - length(replace(text, ' ', '')) = 0
           AND regexp_full_match(text, '[{ALPHABET}]*') AS same
    FROM (SELECT id, text, {_coded_sql('text')} AS coded FROM ({DOCS_SQL}))
""")
def detokenize(spark, sf_dir):
    model = fixed_model()
    decoded = bpe.tokenize(docs(spark, sf_dir), model).withColumn(
        "decoded", bpe.detokenize(F.col("input_ids"), model)
    )
    return decoded.select(
        "id", "decoded",
        (F.replace("decoded", F.lit(" "), F.lit("")) == F.col("text")).alias("same"),
    )


_CHAR_PAIRS_SQL = """
    SELECT pair, CAST(sum(copies) AS BIGINT) AS cnt FROM (
      SELECT copies, unnest(list_transform(range(len(cs) - 1), lambda i: cs[i + 1] || cs[i + 2])) AS pair
      FROM (SELECT string_split(text, '') AS cs, count(*) AS copies FROM documents WHERE text <> '' GROUP BY text))
    GROUP BY pair
"""


@query("bpe_pair_counts", _CHAR_PAIRS_SQL)
def bpe_pair_counts(spark, sf_dir):
    return bpe.pair_counts(docs(spark, sf_dir))


TOP_PAIRS = 20


@query("bpe_top_pairs", f"SELECT pair, cnt FROM ({_CHAR_PAIRS_SQL}) ORDER BY cnt DESC, pair LIMIT {TOP_PAIRS}")
def bpe_top_pairs(spark, sf_dir):
    return bpe.top_pairs(bpe.pair_counts(docs(spark, sf_dir)), TOP_PAIRS)


# ---------------------------------------------------------------- training

VOCAB_SIZE = 120


def _training_sql(rounds: int, size: int = VOCAB_SIZE) -> str:
    """One common table per round: count pairs, take the best, replace it by a new character."""
    first = 0x100
    steps = [f"""
        alphabet AS (
          SELECT list(c ORDER BY c) AS cs FROM (
            SELECT DISTINCT unnest(string_split(text, '')) AS c FROM conversations)),
        s0 AS MATERIALIZED (
          SELECT translate(text, array_to_string(cs, ''), array_to_string(list_transform(
                   range(len(cs)), lambda i: chr(CAST({first} + {len(SPECIAL_TOKENS)} + i AS INTEGER))), '')) AS t,
                 copies
          FROM (SELECT text, count(*) AS copies FROM conversations GROUP BY text), alphabet),
        v0 AS (SELECT list_concat([{_SPECIAL_LIST}], cs) AS tokens FROM alphabet)"""]
    for r in range(rounds):
        steps.append(f"""
        p{r} AS MATERIALIZED (
          SELECT pair FROM (
            SELECT copies, unnest(list_transform(range(len(cs) - 1), lambda i: cs[i + 1] || cs[i + 2])) AS pair
            FROM (SELECT string_split(t, '') AS cs, copies FROM s{r}))
          GROUP BY pair ORDER BY sum(copies) DESC, pair LIMIT 1),
        m{r} AS MATERIALIZED (
          SELECT pair, tokens[unicode(pair[1]) - {first} + 1] AS l, tokens[unicode(pair[2]) - {first} + 1] AS r,
                 tokens, len(tokens) AS n FROM p{r}, v{r}),
        v{r + 1} AS MATERIALIZED (SELECT list_append(tokens, l || r) AS tokens FROM m{r}),
        s{r + 1} AS MATERIALIZED (
          SELECT replace(t, pair, chr(CAST({first} + n AS INTEGER))) AS t, copies FROM s{r}, m{r})""")
    rows = " UNION ALL ".join(
        f"SELECT {r} AS rank, l AS left_token, r AS right_token FROM m{r} WHERE n < {size}"
        for r in range(rounds)
    )
    return f"WITH {','.join(steps)} {rows}"


# The alphabet of the conversations has at least 55 characters, which leaves at most 58 merges.
@query("bpe_train", _training_sql(VOCAB_SIZE - len(SPECIAL_TOKENS) - 55))
def bpe_train(spark, sf_dir):
    model = bpe.train_bpe(table(spark, sf_dir, "conversations").select("text"), VOCAB_SIZE)
    return model.merge_table(spark).withColumnsRenamed({"left": "left_token", "right": "right_token"})


# ---------------------------------------------------------------- the training transform

MAX_LENGTH = 512
FIM_RATE = 0.5
SPM_RATE = 0.5
_ARRANGED_SQL = sql_arranged(DOCS_SQL, SPM_RATE, FIM_RATE, MAX_LENGTH, wrap=True)
_FIM_MIDDLE_ID = _MODEL.ids[FIM_TAGS[2]]


@query("prepare_prefixed", f"""
    SELECT id, array_to_string({_ids_sql('coded')}, ' ') AS seq_input_ids, array_to_string({_ids_sql('coded')}, ' ') AS seq_labels,
           length(coded) AS n_mask, length(coded) AS n_offsets
    FROM (SELECT id, {_coded_sql('text')} AS coded FROM ({_ARRANGED_SQL}))
""")
def prepare_prefixed(spark, sf_dir):
    """The training transform with a prefix before its columns."""
    prepared = prepare_corpus(
        docs(spark, sf_dir), fixed_model(), seed=SEED, max_length=MAX_LENGTH, fim_rate=FIM_RATE,
        spm_rate=SPM_RATE, prefix="seq_",
    )
    return prepared.select(
        "id", _joined(F.col("seq_input_ids")).alias("seq_input_ids"), _joined(F.col("seq_labels")).alias("seq_labels"),
        F.size("seq_attention_mask").cast("bigint").alias("n_mask"), F.size("seq_offset_mapping").cast("bigint").alias("n_offsets"),
    )


@query("prepare_corpus", f"""
    WITH t AS (
      SELECT id, text, is_fim, {_ids_sql('coded')} AS ids
      FROM (SELECT id, text, is_fim, {_coded_sql('text')} AS coded FROM ({_ARRANGED_SQL})))
    SELECT id, text, is_fim, array_to_string(ids, ' ') AS input_ids,
           array_to_string(list_transform(ids, lambda x, i:
             CASE WHEN NOT is_fim OR i > list_position(ids, {_FIM_MIDDLE_ID}) THEN x ELSE -100 END), ' ') AS labels
    FROM t
""")
def prepare_corpus_query(spark, sf_dir):
    prepared = prepare_corpus(
        docs(spark, sf_dir), fixed_model(), seed=SEED, max_length=MAX_LENGTH, fim_rate=FIM_RATE,
        spm_rate=SPM_RATE, fim_sft_style=True,
    )
    return prepared.select(
        "id", "text", "is_fim", _joined(F.col("input_ids")).alias("input_ids"),
        _joined(F.col("labels")).alias("labels"),
    )

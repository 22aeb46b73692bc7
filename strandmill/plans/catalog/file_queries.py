"""Readers and writers end to end: a table is written as files and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmill.functions import text
from strandmill.functions.text import SPECIAL_TOKENS
from strandmill.operators import bpe
from strandmill.operators import metrics as M
from strandmill.plans import files
from strandmill.plans.catalog.corpus import DOC_LINES_SQL, _SEQ_SQL, _sequences
from strandmill.plans.catalog.metric_queries import _COUNTS_SQL, _rows
from strandmill.plans.catalog.padded import padded_sql, padded_text
from strandmill.plans.catalog.registry import (
    DOCS_SQL, SEED, docs, query, sql_arranged, sql_uniform, table,
)
from strandmill.plans.catalog.tokens import _char, _coded_sql, _training_sql, fixed_model
from strandmill.plans.training import training_batches
from strandmill.session import fresh_path
from strandmill.sources.clusters import read_cluster_map, read_idmapping
from strandmill.sources.fasta import read_fasta
from strandmill.sources.lines import read_lines

LOSS_SCALE = 8
GENERATED = "gen"


@query("gz_lines", f"""
    SELECT row_number() OVER (ORDER BY doc_id, pos) - 1 AS id, text FROM ({DOC_LINES_SQL})
""")
def gz_lines(spark, sf_dir):
    path = fresh_path(spark, "gz-lines")
    (
        table(spark, sf_dir, "documents").select("doc_id", "text")
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id")
        .select("text").write.text(path, compression="gzip")
    )
    return read_lines(spark, [path]).select("id", "text")


@query("cluster_file_roundtrip", """
    SELECT CAST(o_custkey AS VARCHAR) AS cluster_id, CAST(o_orderkey AS VARCHAR) AS member_id,
           CAST(dense_rank() OVER (ORDER BY o_custkey) - 1 AS BIGINT) AS ord,
           CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS pos
    FROM orders
""")
def cluster_file_roundtrip(spark, sf_dir):
    """A line per customer with the customer's orders."""
    path = fresh_path(spark, "cluster-lines")
    members = F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda o: o.cast("string"))
    lines = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(members.alias("members"))
    (
        lines.repartitionByRange("o_custkey").sortWithinPartitions("o_custkey")
        .select(F.concat_ws("\t", F.col("o_custkey").cast("string"), "members").alias("value"))
        .write.text(path)
    )
    return read_cluster_map(spark, [path]).select("cluster_id", "member_id", "ord", "pos")


@query("idmapping_file", """
    SELECT CAST(l_orderkey AS VARCHAR) AS key, CASE WHEN l_linenumber < 6 THEN l_returnflag END AS id_type,
           CASE WHEN l_linenumber < 6 THEN CAST(l_partkey AS VARCHAR) END AS value FROM lineitem
""")
def idmapping_file(spark, sf_dir):
    """Triples of a mapping file, and its lines with one field only as rejects."""
    path = fresh_path(spark, "mapping")
    triple = F.concat_ws("\t", F.col("l_orderkey").cast("string"), "l_returnflag", F.col("l_partkey").cast("string"))
    line = F.when(F.col("l_linenumber") < 6, triple).otherwise(F.col("l_orderkey").cast("string"))
    table(spark, sf_dir, "lineitem").select(line.alias("value")).write.text(path)
    triples, rejects = read_idmapping(spark, path, strict=False)
    none = F.lit(None).cast("string")
    return triples.unionByName(
        rejects.select(F.col("line").alias("key"), none.alias("id_type"), none.alias("value"))
    )


@query("generated_fasta", f"""
    SELECT '{GENERATED}_' || doc_id || ' length=' || length(text) AS id, text FROM ({_SEQ_SQL}) WHERE text <> ''
""")
def generated_fasta(spark, sf_dir):
    path = fresh_path(spark, "generated")
    files.write_generated(_sequences(spark, sf_dir), path, GENERATED, index="doc_id")
    return read_fasta(spark, [path])


@query("score_lines", f"""
    WITH t AS (SELECT text, {_coded_sql('text')} AS coded FROM documents),
    s AS (SELECT sum(length(coded)) AS tokens, sum(length(text)) AS chars,
                 sum(length(coded) - length(replace(coded, {_char('[UNK]')}, ''))) AS unk FROM t)
    SELECT 'Tokens per Word: ' || printf('%.2f', CAST(tokens / chars AS DOUBLE)) AS tokens_line,
           'UNK Token Rate:  ' || printf('%.2f', CAST(unk / tokens * 100 AS DOUBLE)) || '%' AS unk_line FROM s
""")
def score_lines(spark, sf_dir):
    model = fixed_model()
    scored = bpe.tokenizer_score(bpe.tokenize(docs(spark, sf_dir), model), model.ids[model.unk])
    return bpe.score_lines(scored)


@query("metric_counts_scaled", f"""
    SELECT phase, step, n_fim * {LOSS_SCALE} AS n_fim, n_std * {LOSS_SCALE} AS n_std FROM ({_COUNTS_SQL})
""")
def metric_counts_scaled(spark, sf_dir):
    return M.metric_counts(_rows(table(spark, sf_dir, "events")), LOSS_SCALE)


EPOCH_LENGTH, EPOCH_BATCH = 64, 4
_EPOCH_SQL = f"""
    SELECT *, '0:' || example AS row_key, '0:' || (example // {EPOCH_BATCH}) AS batch_key FROM (
      SELECT id, text, row_number() OVER (ORDER BY {sql_uniform('epoch0', 'k')}, k) - 1 AS example
      FROM (SELECT *, id || '|0' AS k FROM ({DOCS_SQL})))
"""


@query("training_batches", padded_sql(
    sql_arranged(_EPOCH_SQL, 0.5, 0.5, EPOCH_LENGTH, True, "row_key", "batch_key", "row_key, example,"), EPOCH_BATCH, "id"))
def training_batches_query(spark, sf_dir):
    """An epoch over all documents: ids, labels and mask of every padded example."""
    corpus = docs(spark, sf_dir).withColumn("row_ord", F.lit(0))
    return padded_text(training_batches(
        corpus, fixed_model(), seed=SEED, batch_size=EPOCH_BATCH, max_length=EPOCH_LENGTH, fim_rate=0.5
    ))


@query("file_names", f"""
    SELECT page_id, regexp_extract(name, '([^/]+)$', 1) AS base, regexp_replace(name, '\\.[^.]*$', '') AS stem,
           regexp_replace(name, '/[^/]*$', '') AS folder,
           '{GENERATED}_' || strftime(TIMESTAMP '2020-01-01' + to_seconds(page_id * 86399), '%Y%m%d_%H%M%S') || '.fasta' AS stamped,
           '/pages/' || page_id AS store, 'ids-' || page_id AS ids
    FROM (SELECT page_id, regexp_replace(url, '^[^:]*://', '') || '/page.' || (page_id % 7) || '.html' AS name FROM pages)
""")
def file_names(spark, sf_dir):
    """Names of files made from urls: base, without extension, folder, with a time, and the parts of
    a store's location."""
    name = F.concat(
        F.regexp_replace("url", "^[^:]*://", ""), F.lit("/page."), (F.col("page_id") % 7).cast("string"), F.lit(".html")
    )
    at = F.timestamp_seconds(F.lit(1577836800) + F.col("page_id") * 86399)
    location = F.format_string("store://db/pages/%d#ids-%d", "page_id", "page_id")
    rows = table(spark, sf_dir, "pages").select(
        "page_id", name.alias("name"), at.alias("at"), location.alias("location")
    )
    return rows.select(
        "page_id", text.base_name(F.col("name")).alias("base"), text.without_extension(F.col("name")).alias("stem"),
        text.parent_dir(F.col("name")).alias("folder"), text.stamped_name(GENERATED, F.col("at")).alias("stamped"),
        text.url_path(F.col("location")).alias("store"), text.url_fragment(F.col("location")).alias("ids"),
    )


MODEL_TOKENS = 75


@query("bpe_model_roundtrip", _training_sql(MODEL_TOKENS - len(SPECIAL_TOKENS) - 55, MODEL_TOKENS))
def bpe_model_roundtrip(spark, sf_dir):
    """Merges of a trained vocabulary, written to a file and read back."""
    path = fresh_path(spark, "model")
    bpe.train_bpe(table(spark, sf_dir, "conversations").select("text"), MODEL_TOKENS).save(spark, path)
    merges = bpe.BpeModel.load(spark, path).merge_table(spark)
    return merges.withColumnsRenamed({"left": "left_token", "right": "right_token"})

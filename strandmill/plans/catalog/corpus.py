"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions.text import BLANKS, fasta_record, wrap_lines
from strandmill.plans.catalog.registry import (
    docs, query, sql_body, sql_strip, sql_wrap, table,
)
from strandmill.session import fresh_path, spread
from strandmill.sources.fasta import read_fasta, segment_lines
from strandmill.sources.lines import read_lines
from strandmill.sources.tables import (
    batch_to_rows, corpus_union, read_csv_index, read_table, tagged_splits,
)
from strandmill.sources.writers import write_fasta

# Fixed value: the records of this source are written without a body.
EMPTY_SOURCE = "src7"


def _write_lines(spark: SparkSession, sf_dir: str) -> str:
    """The documents as text files whose names follow ``doc_id``."""
    path = fresh_path(spark, "lines")
    (
        table(spark, sf_dir, "documents").select("doc_id", "text")
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id")
        .select("text").write.text(path)
    )
    return path


DOC_LINES_SQL = f"""
    SELECT doc_id, pos, {sql_strip('line')} AS text FROM (
      SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
      FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\r|\\n') AS ls FROM documents))
    WHERE {sql_strip('line')} <> ''
"""


@query("line_source", f"""
    SELECT row_number() OVER (ORDER BY doc_id, pos) - 1 AS id, text FROM ({DOC_LINES_SQL})
""")
def line_source(spark, sf_dir):
    return read_lines(spark, [_write_lines(spark, sf_dir)]).select("id", "text")


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as FASTA records: header, and a body without blanks and header marks."""
    body = F.translate("text", BLANKS + ">", "")
    return spread(table(spark, sf_dir, "documents"), ["doc_id"]).select(
        F.concat_ws(" ", F.col("doc_id").cast("string"), "source").alias("id"),
        F.when(F.col("source") == EMPTY_SOURCE, "").otherwise(body).alias("text"),
        "doc_id", "source",
    )


_SEQ_SQL = f"""
    SELECT concat_ws(' ', CAST(doc_id AS VARCHAR), source) AS id, doc_id, source,
           CASE WHEN source = '{EMPTY_SOURCE}' THEN '' ELSE {sql_body('text')} END AS text
    FROM documents
"""


@query("fasta_format", f"""
    SELECT id, '>' || id || chr(10) || {sql_wrap('text')} AS record FROM ({_SEQ_SQL})
""")
def fasta_format(spark, sf_dir):
    return _sequences(spark, sf_dir).select("id", fasta_record(F.col("id"), F.col("text")).alias("record"))


def _fasta_files(spark, sf_dir) -> str:
    path = fresh_path(spark, "fasta")
    write_fasta(_sequences(spark, sf_dir), path)
    return path


@query("fasta_parse", f"SELECT id, text FROM ({_SEQ_SQL}) WHERE text <> ''")
def fasta_parse(spark, sf_dir):
    return read_fasta(spark, [_fasta_files(spark, sf_dir)])


@query("fasta_parse_keep_empty", f"SELECT id, text FROM ({_SEQ_SQL})")
def fasta_parse_keep_empty(spark, sf_dir):
    return read_fasta(spark, [_fasta_files(spark, sf_dir)], keep_empty=True, keep_orphan=False)


@query("fasta_segment", f"""
    SELECT file, record_no, id, text FROM (
      SELECT source AS file, row_number() OVER (ORDER BY source, doc_id) AS record_no, id, text
      FROM ({_SEQ_SQL}))
    WHERE text <> ''
""")
def fasta_segment(spark, sf_dir):
    pieces = F.split(wrap_lines(F.col("text")), "\n")
    lines = _sequences(spark, sf_dir).select(
        F.col("source").alias("file"), "doc_id",
        F.posexplode(F.concat(F.array(F.concat(F.lit(">"), "id")), pieces)).alias("pos", "line"),
    ).filter("line <> ''")
    numbered = lines.select(
        "file", (F.col("doc_id") * F.lit(1 << 24) + F.col("pos")).alias("line_no"), "line"
    )
    return segment_lines(numbered)


@query("csv_index", """
    SELECT doc_id AS id, source, n_chars, lang AS dataset FROM documents
""")
def csv_index(spark, sf_dir):
    path = fresh_path(spark, "index")
    (
        table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "n_chars", "lang")
        .write.partitionBy("lang").option("header", True).csv(path)
    )
    schema = "id bigint, source string, n_chars bigint"
    return read_csv_index(spark, [path], schema).select(
        "id", "source", "n_chars",
        F.regexp_extract("dataset", "lang=([^/]+)", 1).alias("dataset"),
    )


@query("table_source", """
    SELECT CAST(doc_id AS VARCHAR) AS id, text, CASE WHEN lang = 'en' THEN 'train' ELSE 'eval' END AS split
    FROM documents
""")
def table_source(spark, sf_dir):
    """English documents for training and all others, whatever their language, for evaluation."""
    path = fresh_path(spark, "splits")
    split = F.when(F.col("lang") == "en", "train").otherwise("eval")
    (
        table(spark, sf_dir, "documents").select("doc_id", "text", split.alias("split"))
        .write.partitionBy("split").parquet(path)
    )
    train, evaluation = (read_table(spark, path, s, id_column="doc_id") for s in ("train", "eval"))
    return tagged_splits(train, evaluation)


def _two_corpora(spark, sf_dir) -> DataFrame:
    bench = table(spark, sf_dir, "benchmark").selectExpr("cast(item_id as string) id", "text")
    return corpus_union([docs(spark, sf_dir), bench])


@query("corpus_union", """
    SELECT CAST(doc_id AS VARCHAR) AS id, text, 0 AS file_ord FROM documents
    UNION ALL SELECT CAST(item_id AS VARCHAR), text, 1 FROM benchmark
""")
def corpus_union_query(spark, sf_dir):
    return _two_corpora(spark, sf_dir)


@query("corpus_counts", """
    SELECT 'rows of corpus ' || file_ord AS what, n FROM (
      SELECT 0 AS file_ord, count(*) AS n FROM documents UNION ALL SELECT 1, count(*) FROM benchmark)
    UNION ALL SELECT 'fasta headers', count(*) FROM documents
    UNION ALL SELECT 'distinct words', count(DISTINCT token) FROM (
      SELECT unnest(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+')) AS token FROM documents) WHERE token <> ''
""")
def corpus_counts(spark, sf_dir):
    rows = _two_corpora(spark, sf_dir).groupBy("file_ord").agg(F.count(F.lit(1)).alias("n"))
    headers = spark.read.text(_fasta_files(spark, sf_dir)).filter(F.col("value").startswith(">"))
    words = docs(spark, sf_dir).select(F.explode(F.split("text", "[ \\t\\n\\r\\f]+")).alias("token"))
    distinct = words.filter("token <> ''").distinct()
    corpora = rows.select(
        F.concat(F.lit("rows of corpus "), F.col("file_ord").cast("string")).alias("what"), "n"
    )
    counted = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
        for what, df in (("fasta headers", headers), ("distinct words", distinct))
    ]
    return corpora.unionByName(counted[0]).unionByName(counted[1])


@query("batch_to_rows", """
    SELECT vec_id, label, unnest(range(len(embedding))) AS pos,
           round(CAST(unnest(embedding) AS DOUBLE), 6) AS value
    FROM embeddings
""")
def batch_to_rows_query(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.col("embedding").alias("value"),
        F.sequence(F.lit(0).cast("bigint"), F.size("embedding").cast("bigint") - 1).alias("pos"),
    )
    return batch_to_rows(vectors, ["pos", "value"]).withColumn(
        "value", F.round(F.col("value").cast("double"), 6)
    )

"""One query per operator over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm import (
    collocations, decontaminate, fim_pieces, jaccard, langid, linkgraph, preference, quality, simhash, substrings, token_files, warc, word_bpe,
)
from strandmill.llm.oracles import (
    COLLOCATIONS_SQL, FIM_SQL, LEAKS_SQL, LINKS_SQL, PAGE_RULES, WARC_SQL, preference_sql, url_filter_sql,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return token_files.tokenizer_text(public_tokenizers.path(name))


@query("op1_token_files")
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_files.token_file_digests(docs, tokenizer("byte_bpe_50k.json"))


@query("op2_decontamination", LEAKS_SQL)
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.withColumn("similarity", F.round("similarity", 9))


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


@query("op4_word_bpe")
def op4_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return word_bpe.encode_digests(docs, tokenizer("word_bpe_49k.json"))


@query("op5_ngram_jaccard", LINKS_SQL)
def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked_documents(table(spark, sf_dir, "documents"))


@query("op6_preference_pairs", preference_sql())
def op6_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = preference.pairs_from_conversations(table(spark, sf_dir, "conversations"))
    pairs = preference.preference_pairs(turns)
    return preference.with_mask_text(pairs)


@query("op7_substring_dedup")
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(table(spark, sf_dir, "documents"))


@query("op8_url_filters", url_filter_sql(PAGE_RULES))
def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = linkgraph.judge_pages(table(spark, sf_dir, "pages"), PAGE_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op9_warc_revisits", WARC_SQL)
def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.resolve_revisits(warc.records_from_pages(table(spark, sf_dir, "pages")))


@query("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trusted = quality.trusted_ids(table(spark, sf_dir, "labels"))
    return quality.judge(docs, quality.log_ratios(quality.ngram_counts(docs, trusted)), trusted)


@query("op11_collocations", COLLOCATIONS_SQL)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op12_fill_in_middle", FIM_SQL)
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_pieces.rearranged_digests(table(spark, sf_dir, "documents"))


@query("op13_simhash_dedup")
def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"))

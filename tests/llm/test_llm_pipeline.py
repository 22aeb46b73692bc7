"""Queries against their SQL, and the pipeline against a plain version of every stage."""

import hashlib

import numpy as np
import pytest
from helpers import shingles
from oracle import connect, differences
from test_llm_sets import expected_leaks, expected_links
from test_llm_texts import expected_passages
from test_llm_tokens import WORDS
from tokenizers import Tokenizer

import corpus_pipeline
from strandmill.llm import quality, substrings
from strandmill.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert differences(spark, con, QUERIES[name], ORACLES[name], SF_DIR) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_has_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_pipeline_equals_plain_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    trusted = quality.trusted_ids(labels)
    ratios = quality.log_ratios(quality.ngram_counts(docs, trusted))
    kept = {r.doc_id for r in quality.judge(docs, ratios, trusted).where("kept").collect()}
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if r.doc_id in kept]
    first = expected_links(rows)
    rows = [(i, t) for i, t in rows if first[i][1] == i]
    cuts = [c for c in expected_passages(rows, substrings.MIN_WORDS) if not c[4]]
    spans = {i: sorted((a, b) for d, a, b, _, _ in cuts if d == i) for i, _ in rows}
    rows = [(i, substrings.cut_out(t.encode(), spans[i]) if spans[i] else t) for i, t in rows]
    rows = [(i, t) for i, t in rows if not spans[i] or shingles(t)]
    leaking = {d for d, _ in expected_leaks(rows, items)}
    lib = Tokenizer.from_str(WORDS)
    want = set()
    for i, t in rows:
        if i not in leaking:
            ids = lib.encode(t or "", add_special_tokens=False).ids
            want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()))
    got = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {(r.doc_id, r.n_tokens, r.ids_sha256) for r in got} == want and len(got) == len(want)
    assert 0 < len(got) < len(first)


def test_stages_keep_the_columns(spark):
    now = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, SF_DIR)
        assert out.columns == now.columns and out.count() == 0

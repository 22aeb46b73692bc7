import pytest
from conftest import rows
from pyspark.sql import functions as F

from strandmill.functions import fim
from strandmill.functions.keyed import randint, uniform
from strandmill.plans.prepare import arrange_text


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column).first()[0]


@pytest.mark.parametrize("spm, want", [
    (True, "<fim_suffix>EF<fim_prefix>AB<fim_middle>CD"),
    (False, "<fim_prefix>AB<fim_suffix>EF<fim_middle>CD"),
])
def test_layouts_and_inverse(spark, spm, want):
    got = one(spark, "ABCDEF", fim.rearranged(F.col("text"), F.lit(2), F.lit(4), F.lit(spm)))
    assert got == want
    assert one(spark, got, fim.defim_reconstruct(F.col("text"))) == "ABCDEF"
    assert one(spark, got, fim.defim_strip(F.col("text"))) == ("EFABCD" if spm else "ABEFCD")


@pytest.mark.parametrize("text, want", [
    ("QQ<fim_suffix>SS<fim_prefix>PP<fim_middle>MM<fim_middle>NN", "QQPPMMNNSS"),
    ("plain", "plain"), ("", ""), ("<fim_other>x", "<fim_other>x"),
    ("<fim_middle>M<fim_prefix>P<fim_pre<fim_prefix>fix>", "P<fim_prefix>M"),
])
def test_reconstruct(spark, text, want):
    assert one(spark, text, fim.defim_reconstruct(F.col("text"))) == want


@pytest.mark.parametrize("limit", [None, 0, 6, 9])
def test_crop_off(spark, limit):
    df = spark.createDataFrame([("k", "ABCDEF")], "id string, text string")
    assert fim.random_crop(df, limit, 1).first()["text"] == "ABCDEF"


def corpus(spark, n=600):
    return spark.range(n).select(
        F.col("id").cast("string").alias("id"),
        F.substring(F.md5(F.col("id").cast("string")), F.lit(1), (F.col("id") % 20).cast("int")).alias("text"),
    )


def test_crop_takes_every_start(spark):
    df = spark.range(400).select(F.col("id").cast("string").alias("id"), F.lit("ABCDEF").alias("text"))
    got = {r["text"] for r in fim.random_crop(df, 4, 1).collect()}
    assert got == {"ABCD", "BCDE", "CDEF"}


def test_rearranged_texts_come_back(spark):
    base = {r["id"]: r["text"] for r in corpus(spark).collect()}
    out = fim.fim_apply(corpus(spark), seed=7).withColumn("back", fim.defim_reconstruct(F.col("text"))).collect()
    spm = 0
    for r in out:
        assert r["back"] == base[r["id"]]
        assert r["is_fim"] == (base[r["id"]] != "")
        if r["is_fim"]:
            assert not r["text"].endswith("<fim_middle>")
            spm += r["text"].startswith("<fim_suffix>")
    assert 0.4 < spm / sum(r["is_fim"] for r in out) < 0.6


def test_cuts_reach_both_ends(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("id"), F.lit("ABC").alias("text"))
    middles = {r["text"].split("<fim_middle>")[1] for r in fim.fim_apply(df, seed=1).collect()}
    assert middles == {"A", "AB", "ABC", "B", "BC", "C"}


def test_rates_batches_and_reserve(spark):
    df = corpus(spark).withColumn("batch", F.expr("cast(id as int) div 50").cast("string"))
    out = arrange_text(df, seed=3, fim_rate=0.5, max_length=12, batch_key="batch").filter("length(text) > 10")
    per_batch = out.filter("is_fim is not null").groupBy("batch").agg(F.countDistinct("is_fim").alias("n"))
    kinds = {r["n"] for r in per_batch.collect()}
    assert kinds <= {1, 2}  # an empty text in a rearranged batch is not marked
    for r in out.collect():
        assert r["text"].startswith("[BOS]") and r["text"].endswith("[EOS]")
        body = r["text"][5:-5]
        assert len(fim.FIM_TAGS[0]) * 3 + 7 >= len(body) - 4 if r["is_fim"] else len(body) <= 10
    assert arrange_text(df, seed=3, generate=True).filter(F.col("text").endswith("[EOS]")).count() == 0


def test_draws_do_not_depend_on_partitions(spark):
    results = [
        rows(arrange_text(corpus(spark).repartition(n), seed=9, fim_rate=0.5, max_length=9)) for n in (1, 2, 7)
    ]
    assert results[0] == results[1] == results[2]


def test_uniform_and_randint(spark):
    df = spark.range(20_000).select(uniform(1, "x", "id").alias("u")).select(
        "u", randint(F.col("u"), F.lit(2), F.lit(5)).alias("i"))
    low, high, mean = df.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= low < 0.001 and 0.999 < high < 1 and abs(mean - 0.5) < 0.01
    assert {r["i"]: r["count"] > 4500 for r in df.groupBy("i").count().collect()} == {2: True, 3: True, 4: True, 5: True}

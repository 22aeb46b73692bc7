from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_bpe import nested_model

from strandmill.functions.fim import defim_strip
from strandmill.operators import bpe
from strandmill.plans import files, training
from strandmill.sources.clusters import read_cluster_map
from strandmill.sources.fasta import read_fasta


def test_clean_fasta(spark, write):
    path = write("gen.fasta", ">a 1\nQQ<fim_suffix>SS<fim_pre\nfix>PP<fim_middle>MM\n>b\nAC\n")
    out = files.clean_fasta(spark, path)
    assert out.endswith("gen_clean.fasta") and files.count_records(spark, out) == 2
    assert rows(read_fasta(spark, [out])) == [("a 1", "QQPPMMSS"), ("b", "AC")]
    stripped = files.clean_fasta(spark, path, path + ".stripped", strip_only=True)
    assert rows(read_fasta(spark, [stripped])) == [("a 1", "QQSSPPMM"), ("b", "AC")]


def test_generated_file(spark, tmp_path):
    df = spark.createDataFrame([(0, "MV"), (1, "A" * 70)], "index int, text string")
    files.write_generated(df, str(tmp_path / "g"), "gen")
    assert rows(read_fasta(spark, [str(tmp_path / "g")])) == [("gen_0 length=2", "MV"), ("gen_1 length=70", "A" * 70)]


def test_build_store(spark, write, tmp_path):
    path = write("m.tsv", "P1\tUniRef50\tU\nP2\tUniRef50\tU\nP2\tUniRef90\tV\nP1\tUniRef50\tU\n")
    out = str(tmp_path / "s.db")
    assert files.build_cluster_store(spark, path, out, key_format="UniRef50_%s") == 1
    assert rows(read_cluster_map(spark, [out]).select("cluster_id", "member_id")) == [("U", "UniRef50_P1"), ("U", "UniRef50_P2")]


def corpus(spark):
    return spark.range(30).select(
        F.col("id").cast("string").alias("id"), F.col("id").alias("row_ord"),
        F.repeat(F.lit("abc"), (F.col("id") % 7).cast("int")).alias("text"))


@pytest.mark.parametrize("clustered", [False, True])
def test_training_batches(spark, write, clustered):
    model = nested_model()
    members = read_cluster_map(spark, [write("c.tsv", "".join(f"c{i % 9}\t{i}\n" for i in range(20)))]) if clustered else None
    options = dict(seed=5, batch_size=4, fim_rate=0.5, fim_sft_style=True, max_length=14)
    out = training.training_batches(corpus(spark), model, members=members, **options).collect()
    n = 9 if clustered else 30
    assert sorted(r["example"] for r in out) == list(range(n))
    texts = {r["id"]: r["text"] for r in corpus(spark).collect()}
    assert {r["id"] for r in out} <= {str(i) for i in range(20 if clustered else 30)}
    for batch, size in Counter(r["batch_id"] for r in out).items():
        group = [r for r in out if r["batch_id"] == batch]
        assert size == min(4, n - batch * 4) and {r["example"] // 4 for r in group} == {batch}
        assert len({len(r["input_ids"]) for r in group}) == 1
        assert len({r["is_fim"] for r in group if texts[r["id"]]}) <= 1
        assert any(all(r["attention_mask"]) for r in group)
        for r in group:
            kept = sum(r["attention_mask"])
            ids = r["input_ids"]
            assert r["attention_mask"] == [1] * kept + [0] * (len(ids) - kept)
            assert set(ids[kept:]) <= {model.ids["[PAD]"]} and set(r["labels"][kept:]) <= {-100}
            names = [model.tokens[i] for i in ids[:kept]]
            assert names[0] == "[BOS]" and names[-1] == "[EOS]"
            if not r["is_fim"]:
                assert "".join(names[1:-1]) in texts[r["id"]] and len("".join(names)) <= 12 + 10
                assert r["labels"][:kept] == ids[:kept]
    again = training.training_batches(corpus(spark).repartition(3), model, members=members, **options)
    key = lambda r: (r["example"], r["id"], r["input_ids"], r["labels"])
    assert sorted(map(key, again.collect())) == sorted(map(key, out))


def test_epochs_differ(spark):
    one, two = (
        {r["example"]: r["id"] for r in training.examples(corpus(spark), None, 1, epoch).collect()} for epoch in (0, 1)
    )
    assert one != two and sorted(one.values()) == sorted(two.values())


def test_score_lines(spark):
    model = nested_model()
    df = spark.createDataFrame([("1", "ab?"), ("2", "c")], "id string, text string")
    line = bpe.score_lines(bpe.tokenizer_score(bpe.tokenize(df, model), 0)).first()
    assert tuple(line) == ("Tokens per Word: 0.75", "UNK Token Rate:  33.33%")


def test_strip_needs_no_tags(spark):
    assert spark.createDataFrame([("AC",)], "t string").select(defim_strip(F.col("t"))).first()[0] == "AC"


def test_every_language_has_a_split(spark, tmp_path):
    from strandmill.plans.catalog import QUERIES

    docs = [(1, "a", "en"), (2, "b", "de"), (3, "c", "xx"), (4, "d", None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["table_source"](spark, str(tmp_path)).select("id", "split")
    assert rows(got) == [("1", "train"), ("2", "eval"), ("3", "eval"), ("4", "eval")]

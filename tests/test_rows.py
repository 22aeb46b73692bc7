"""Labels, padding, batch plans, structures, metrics, streams."""

import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from strandmill.functions import residues as R
from strandmill.operators import batches, labels, metrics, structures
from strandmill.sources.tables import read_structure_index, read_structures
from strandmill.session import fresh_path, materialize, scratch
from strandmill.streaming import streams


def test_labels(spark):
    df = spark.createDataFrame([([5, 9, 7, 8], [1, 1, 1, 0]), ([5, 7, 8], [1, 1, 1])], "ids array<int>, m array<int>")
    out = df.withColumn("l", labels.labels(F.col("ids"), F.col("m"))).withColumn("s", labels.sft_labels(F.col("l"), 9))
    assert [(r["l"], r["s"]) for r in out.collect()] == [
        ([5, 9, 7, -100], [-100, -100, 7, -100]), ([5, 7, 8], [-100] * 3)]


def test_padding(spark):
    df = spark.createDataFrame([(0, 1, [1, 2]), (0, 2, [4]), (1, 3, []), (0, 4, [])], "b int, i int, ids array<int>")
    out = labels.pad_batches(df, "b", "ids", 3).orderBy("i").collect()
    assert [(r["ids"], r["attention_mask"]) for r in out] == [
        ([1, 2], [1, 1]), ([4, 3], [1, 0]), ([], []), ([3, 3], [0, 0])]


def test_token_ids_and_offsets(spark, monkeypatch):
    vocab = spark.createDataFrame([("a", 7), ("b", 8)], "token string, token_id int")
    tokens = spark.createDataFrame([(0, "a"), (1, "zz"), (2, "a"), (3, "a")], "pos int, token string")
    for bound in (10, 1):
        monkeypatch.setattr(labels, "BROADCAST_TOKENS", bound)
        got = labels.token_ids(tokens, vocab, ["pos"], 0, hot_rows=2)
        assert rows(got.select("pos", "token_id")) == [(0, 7), (1, 0), (2, 7), (3, 7)]
    spans = spark.createDataFrame([(["ab", "c", "déf"],), ([],)], "t array<string>").select(labels.token_offsets(F.col("t")))
    assert [[tuple(x) for x in r[0]] for r in spans.collect()] == [[(0, 2), (2, 3), (3, 6)], []]


@pytest.mark.parametrize("longest, size", [(200, 8), (201, 4), (500, 4), (501, 2), (700, 2), (701, 1)])
def test_fold_plan_sizes(spark, longest, size):
    df = spark.range(9).select(
        F.lit(2).alias("file_ord"), F.col("id").alias("row_id"),
        F.when(F.col("id") == 3, longest).otherwise(5).alias("length"))
    out = batches.fold_batch_plan(df).orderBy("row_id").collect()
    assert [r["batch_size"] for r in out] == [size] * 8 + [8]
    assert [r["sub_batch"] for r in out] == [i // size for i in range(8)] + [0]
    assert (out[2]["out_name"], out[8]["out_name"]) == ("esm_3.pdb_esm_2_0.pdb", "esm_1.pdb_esm_2_8.pdb")


def test_fold_plan_takes_any_chunk(spark):
    df = spark.range(3).select(F.lit(0).alias("file_ord"), F.col("id").alias("row_id"), F.lit(600).alias("length"))
    assert [(r["batch_size"], r["sub_batch"]) for r in batches.fold_batch_plan(df).orderBy("row_id").collect()] == [(2, 0), (2, 0), (2, 1)]


def test_latest(spark):
    df = spark.createDataFrame([("checkpoint-9",), ("checkpoint-10",), ("checkpoint-x",)], "path string")
    assert rows(batches.latest_by_suffix(df)) == [("checkpoint-10",)]


def test_epoch_order(spark):
    ids = spark.range(200).select(F.col("id").cast("string").alias("id"))
    one, two = (dict(rows(batches.epoch_shuffle(ids, 1, e))) for e in (1, 2))
    assert sorted(one.values()) == sorted(two.values()) == list(range(200)) and one != two
    assert dict(rows(batches.epoch_shuffle(ids.repartition(7), 1, 1))) == one


def residue_table(spark):
    fill = 1e-5
    def atoms(missing=()):
        return [[fill if i in missing else float(i + 1), float(10 * i), -1.0] for i in range(4)]
    data = [("d", "p", 0, "GLY", 7, "A:GLY:12", atoms([2])), ("d", "p", 1, "ALA", 0, "A:ALA:13", atoms([3])),
            ("d", "p", 2, "XXX", 0, "A:XXX:15", atoms())]
    return spark.createDataFrame(
        data, "dataset string, chain_id string, pos int, residue_name string, residue_type int, residue_id string, coords array<array<double>>")


def test_structure_features(spark):
    out = structures.structure_features(residue_table(spark), 1e-5).orderBy("pos").collect()
    assert [r["residue_idx"] for r in out] == [0, 1, 3]
    assert "".join(r["letter"] for r in out) == "GAA"
    assert out[0]["coord_mask"] == [True, True, False, True]
    assert out[0]["distogram"]["pseudo_beta"] == [2.0, 10.0, -1.0] and out[0]["distogram"]["mask"]
    assert out[1]["distogram"]["pseudo_beta"][1] == 30.0 and not out[1]["distogram"]["mask"]
    assert all(math.isnan(x) for x in out[0]["backbone"]["c"])
    assert all(math.isnan(x) for x in out[1]["backbone"]["cb"])
    assert out[2]["backbone"]["n"] == [1.0, 0.0, -1.0]
    assert rows(structures.residue_sequences(residue_table(spark))) == [("d", "p", "GAA")]
    chain = structures.chain_features(residue_table(spark).repartition(3), 1e-5).first()
    assert (chain.text, chain.residue_idx, chain.n_residues) == ("GAA", [0, 1, 3], 3)
    assert chain.coord_mask == [r["coord_mask"] for r in out] and chain.coords == [r["coords"] for r in out]
    assert chain.pseudo_beta == [r["distogram"]["pseudo_beta"] for r in out]
    assert chain.pseudo_beta_mask == [r["distogram"]["mask"] for r in out]
    assert math.isnan(chain.backbone[0]["c"][0]) and chain.backbone[2]["n"] == [1.0, 0.0, -1.0]


def test_residue_number_must_be_numeric(spark):
    df = spark.createDataFrame([("A:GLY:x",)], "r string")
    with pytest.raises(Exception):
        df.select(R.residue_number(F.col("r"))).collect()


def test_store_with_and_without_id_list(spark, tmp_path, write):
    store = str(tmp_path / "store")
    table = residue_table(spark)
    table.unionByName(table.withColumn("chain_id", F.lit("q"))).drop("dataset").write.parquet(store)
    url = f"{store}#{write('ids.txt', '# all but p' + chr(10) + 'q' + chr(10))}"
    assert read_structures(spark, store).count() == 6
    assert {(r["chain_id"], r["dataset"]) for r in read_structures(spark, url).collect()} == {("q", url)}
    assert rows(read_structure_index(spark, [url, store])) == sorted([("p", store), ("q", store), ("q", url)], key=repr)


@pytest.mark.parametrize("hot_rows", [1, 1000])
def test_structure_lookup_keeps_repeats_of_the_index(spark, hot_rows):
    index = spark.createDataFrame([("p", "d", 1), ("p", "d", 2), ("p", "other", 3)], "id string, dataset string, n int")
    got = structures.structure_lookup(index, residue_table(spark), hot_rows)
    assert rows(got.select("n", "pos")) == [(n, p) for n in (1, 2) for p in range(3)]


def metric_rows(spark):
    data = [("train", 0, True, 2.0)] * 3 + [("train", 0, False, 2.0), ("train", 1, False, 4.0), ("eval", 0, True, 1.0)]
    return spark.createDataFrame(data, "phase string, step bigint, is_fim boolean, loss double")


def test_metrics(spark):
    by_tag = {(r["phase"], r["step"]): r for r in metrics.metric_loss_by_tag(metric_rows(spark)).collect()}
    first, second = by_tag["train", 0], by_tag["train", 1]
    assert (first["n_fim"], first["n_std"], first["loss_fim"], first["loss_std"]) == (3, 1, 1.5, 0.5)
    assert (second["loss_fim"], second["loss_std"]) == (None, 4.0)
    rolled = {r["phase"]: r for r in metrics.metric_rollup(metrics.metric_loss_by_tag(metric_rows(spark))).collect()}
    assert (rolled["train"]["loss_fim"], rolled["train"]["loss_std"], rolled["train"]["n_fim"]) == (1.5, 2.25, 1.5)
    scaled = {(r["phase"], r["step"]): r for r in metrics.metric_counts(metric_rows(spark), loss_scale=2).collect()}
    assert scaled["train", 0]["n_fim"] == 6


def test_stream_of_lines(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text(" MVSK \n\nGEEL\nMVSK\n")
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")

    def run():
        lines = streams.stream_lines(spark, str(folder))
        streams.drain(streams.stream_prepare(lines, seed=1, fim_rate=0.0), out, progress)
        return spark.read.parquet(out).collect()

    first = run()
    assert sorted(r["text"] for r in first) == ["[BOS]GEEL[EOS]", "[BOS]MVSK[EOS]", "[BOS]MVSK[EOS]"]
    assert len({r["id"] for r in first}) == 2
    (folder / "b.txt").write_text("AAA\n")
    assert sorted(r["text"] for r in run()) == ["[BOS]AAA[EOS]", *sorted(r["text"] for r in first)]


def test_stream_windows_close_behind_the_watermark(spark, tmp_path):
    folder = str(tmp_path / "rows")
    data = [("2024-01-01 00:10:00", True, 1.0), ("2024-01-01 00:20:00", True, 3.0),
            ("2024-01-01 00:30:00", False, 5.0), ("2024-01-01 02:30:00", True, 9.0)]
    schema = "ts timestamp, is_fim boolean, loss double"
    batch = spark.createDataFrame(data, "ts string, is_fim boolean, loss double").withColumn("ts", F.to_timestamp("ts"))
    batch.coalesce(1).write.parquet(folder)
    windows = streams.stream_metric_windows(spark.readStream.schema(schema).parquet(folder), "1 hour", "30 minutes")
    streams.drain(windows, str(tmp_path / "out"), str(tmp_path / "progress"))
    got = rows(spark.read.parquet(str(tmp_path / "out")).select(F.hour("window_start"), "tag", "loss", "n"))
    assert got == [(0, "fim", 2.0, 2), (0, "std", 5.0, 1)]
    whole = metrics.metric_windows(batch, "1 hour")
    assert whole.count() == 3


def test_scratch_tables_live_as_long_as_the_block(spark):
    kept = fresh_path(spark, "kept")
    with scratch(spark):
        inner = fresh_path(spark, "inner")
        table = materialize(spark.range(9), "table")
        assert table.inputFiles() and all("/scratch-" in f for f in table.inputFiles())
        table.write.parquet(kept)
    folder = spark._jvm.org.apache.hadoop.fs.Path(inner).getParent()
    assert not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    assert spark.read.parquet(kept).count() == 9 and "/scratch-" not in fresh_path(spark, "after")

import gzip
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from strandmill.functions import text as T
from strandmill.sources import clusters, fasta, lines, tables, writers

FASTA = (
    "orphan\n\n>a desc one\r\nMVSK\r\nGEEL \n  >b indented\nAAA\n>empty\n>c\nGG\n\nHH\n"
)


def test_lines_run_across_files(spark, write):
    paths = [write("b.txt", "\n  MVSK \n\nGEEL\n"), write("a.txt", "AAA")]
    assert rows(lines.read_lines(spark, paths).select("id", "text")) == [
        (0, "MVSK"), (1, "GEEL"), (2, "AAA")]


def test_lines_repeat_a_file_and_read_gzip(spark, tmp_path):
    path = str(tmp_path / "x.txt.gz")
    with gzip.open(path, "wt") as f:
        f.write("A\nB\n")
    got = rows(lines.read_lines(spark, [path, path]).select("id", "text"))
    assert got == [(0, "A"), (1, "B"), (2, "A"), (3, "B")]


def test_line_ids_over_many_splits(spark, write, small_splits):
    rng = random.Random(3)
    texts = [["", "  ", *["x" * rng.randint(0, 40) + str(i) for i in range(200)]] for _ in range(3)]
    paths = [write(f"{i}.txt", "\n".join(t)) for i, t in enumerate(texts)]
    want = [x.strip() for t in texts for x in t if x.strip()]
    scan = lines.scan_text(spark, paths)
    splits = scan.select("file_path", "block_start").distinct().count()
    assert lines.split_bound(scan) >= splits > 20
    assert rows(lines.read_lines(spark, paths).select("id", "text")) == sorted(enumerate(want), key=repr)


def plan_of(df):
    """The first plan, before it is adapted."""
    return df._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[2] or (
        df._jdf.queryExecution().executedPlan().toString())


def test_folders_patterns_and_repeated_paths(spark, tmp_path, monkeypatch):
    for name, text in (("d/b.txt", "B1\nB2"), ("d/a.txt", "A1"), ("e x/c.txt", "C1\n\nC2"), ("f/k=2/z.txt", "Z"), ("f/k=1/y.txt", "Y")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    at = lambda *names: [f"{tmp_path}/{n}" for n in names]
    want = [
        (at("d/b.txt", "d"), ["B1", "B2", "A1", "B1", "B2"]),
        (at("e x", "d/*.txt", "d/a.txt"), ["C1", "C2", "A1", "B1", "B2", "A1"]),
        (at("f"), ["Y", "Z"]),
        ([f"file:{tmp_path}/d/", f"file://{tmp_path}/e x/c.txt"], ["A1", "B1", "B2", "C1", "C2"]),
    ]
    for broadcast in (lines.BROADCAST_SPLITS, 0):
        monkeypatch.setattr(lines, "BROADCAST_SPLITS", broadcast)
        for paths, texts in want:
            got = lines.read_lines(spark, paths).select("id", "text")
            assert rows(got) == sorted(enumerate(texts), key=repr)
    restarted = lines.read_lines(spark, at("d", "e x", "d/a.txt"), per_path=True)
    assert rows(restarted.select("file_ord", "id", "text")) == [
        (0, 0, "A1"), (0, 1, "B1"), (0, 2, "B2"), (1, 0, "C1"), (1, 1, "C2"), (2, 0, "A1")]


def test_many_paths_are_one_scan(spark, tmp_path):
    paths = []
    for i in range(300):
        (tmp_path / f"{i}.txt").write_text(f"t{i}\nu{i}\n")
        paths.append(str(tmp_path / f"{i}.txt"))
    got = lines.read_lines(spark, [*paths, paths[7]])
    assert plan_of(got).count("FileScan text") == 1 and "SinglePartition" not in plan_of(got)
    want = [t for i in [*range(300), 7] for t in (f"t{i}", f"u{i}")]
    assert rows(got.select("id", "text")) == sorted(enumerate(want), key=repr)


def test_cluster_files_and_stores_are_one_map(spark, write, tmp_path):
    store = str(tmp_path / "x.db")
    spark.createDataFrame([("s", "m")], "cluster_id string, member_id string").write.parquet(store)
    paths = [write("a.tsv", "c1\tx\ty\n\nc2\n"), store, write("b.tsv", "c3\tz"), write("a.tsv", "c1\tx\ty\n\nc2\n")]
    got = clusters.read_cluster_map(spark, paths)
    a = lambda i: [(i, "c1", "x", 0, 0), (i, "c1", "y", 0, 1), (i, "c2", None, 1, None)]
    assert rows(got) == sorted([*a(0), (1, "s", "m", 0, 0), (2, "c3", "z", 0, 0), *a(3)], key=repr)
    assert plan_of(got).count("FileScan text") == 1


def test_strip_matches_python(spark):
    samples = ["　\x1c a b \x85\n", "\xa0", "x", "᠎ x", "﻿y "]
    df = spark.createDataFrame(list(enumerate(samples)), "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(T.strip(F.col("s"))).collect()]
    assert got == [s.strip() for s in samples]
    assert all(c.isspace() for c in T.BLANKS)


def test_fasta_corpus_and_evaluation_readers(spark, write):
    path = write("x.fasta", FASTA)
    assert rows(fasta.read_fasta(spark, [path])) == [
        ("", "orphan"), ("a desc one", "MVSKGEEL"), ("b indented", "AAA"), ("c", "GGHH")]
    assert rows(fasta.read_fasta(spark, [path], keep_empty=True, keep_orphan=False)) == [
        ("a desc one", "MVSKGEEL"), ("b indented", "AAA"), ("c", "GGHH"), ("empty", "")]


@pytest.mark.parametrize("first", ["", "\n", ">>x\nAA\n", "\n>y\nBB\n", "lost\n"])
def test_fasta_double_marks_and_first_record(spark, write, first):
    path = write("d.fasta", first + ">>z\nCC\n>w\nDD")
    want = [(">z", "CC"), ("w", "DD")]
    want += {">>x\nAA\n": [(">x", "AA")], "\n>y\nBB\n": [("y", "BB")], "lost\n": [("", "lost")]}.get(first, [])
    assert rows(fasta.read_fasta(spark, [path])) == sorted(want, key=repr)


def _parse(text):
    """Brute force over stripped lines, for the corpus reader."""
    out, head, body = [], "", ""
    for line in (x.strip() for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
        if line.startswith(">"):
            out.append((head, body))
            head, body = line[1:], ""
        else:
            body += line
    return [r for r in [*out, (head, body)] if r[1]]


def test_fasta_over_many_splits(spark, write, small_splits):
    rng = random.Random(5)
    files = []
    for _ in range(3):
        out = ["stray\n"] if rng.random() < 0.5 else []
        for i in range(120):
            out.append(rng.choice([">", ">", ">", ">>", " >"]) + f"r{i} {'h' * rng.randint(0, 30)}" + rng.choice(["\n", "\r\n"]))
            out += ["ACDE" * rng.randint(0, 9) + rng.choice(["\n", "\n\n", " \n"]) for _ in range(rng.randint(0, 3))]
        files.append("".join(out))
    paths = [write(f"{i}.fa", t) for i, t in enumerate(files)]
    want = sorted((r for t in files for r in _parse(t)), key=repr)
    got = fasta.read_fasta(spark, paths)
    assert rows(got) == want
    assert plan_of(got).count("FileScan text") == 1
    twice = fasta.read_fasta(spark, [paths[1], *paths])
    assert rows(twice) == sorted([*want, *_parse(files[1])], key=repr)


def test_fasta_carriage_returns_only(spark, write):
    assert rows(fasta.read_fasta(spark, [write("m.fa", ">a\rAB\rC\r>b\rD")])) == [("a", "ABC"), ("b", "D")]


def test_segment_lines(spark):
    data = [("f", 1, "lost"), ("f", 2, ">a"), ("f", 3, "X"), ("f", 4, "Y"), ("f", 5, ">e"),
            ("g", 1, "Q"), ("g", 2, ">b"), ("g", 3, "Z")]
    df = spark.createDataFrame(data, "file string, line_no bigint, line string")
    got = rows(fasta.segment_lines(df).select("file", "id", "text"))
    assert got == [("f", "", "lost"), ("f", "a", "XY"), ("g", "", "Q"), ("g", "b", "Z")]


@pytest.mark.parametrize("parts", ["1", "3", "40"])
def test_records_over_many_partitions(spark, parts):
    """A record may begin in one partition, fill others, and end in a later one."""
    rng = random.Random(8)
    data, want, record_no = [], [], 0
    for file in ("f1", "f2", "f3"):
        head, body, seen = "", [], record_no
        for no in range(150):
            line = f">h{file}{no}" if rng.random() < (0.04 if file == "f2" else 0.4) else rng.choice(["", "AC", "GGé"])
            data.append((file, no, line))
            if line.startswith(">"):
                want.append((file, record_no, head, "".join(body)))
                record_no, head, body = record_no + 1, line[1:], []
            else:
                body.append(line)
        want.append((file, record_no, head, "".join(body)))
    df = spark.createDataFrame(data, "file string, line_no bigint, line string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = fasta.segment_lines(df)
        assert rows(got) == sorted((w for w in want if w[3]), key=repr)
        # The lines were moved once, to be sorted; what is read now has a row per record.
        assert plan_of(got).count("Exchange hashpartitioning") <= 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert fasta.segment_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 59, 60, 61, 120, 125])
def test_wrap(spark, n):
    text = ("ABCDEFGHIé" * 13)[:n]
    got = spark.createDataFrame([(text,)], "t string").select(T.wrap_lines(F.col("t"))).first()[0]
    assert got == "\n".join(text[i:i + 60] for i in range(0, n, 60))


def test_fasta_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a b", "AC" * 70), ("c", ""), ("d", "G" * 60)], "id string, text string")
    for codec in (None, "gzip"):
        path = str(tmp_path / f"out-{codec}")
        writers.write_fasta(df, path, compression=codec)
        assert rows(fasta.read_fasta(spark, [path], keep_empty=True)) == rows(df)
    assert writers.clean_path("x/gen.v1.fasta") == "x/gen.v1_clean.fasta"


def test_names(spark):
    one = spark.createDataFrame([("a/b.c/gen.fasta", "MV")], "p string, t string").select(
        T.without_extension(F.col("p")), T.base_name(F.col("p")), T.parent_dir(F.col("p")),
        T.generated_header("gen", F.lit(3), F.col("t")),
        T.stamped_name("generated", F.lit("2024-05-06 07:08:09").cast("timestamp")),
    ).first()
    assert tuple(one) == ("a/b.c/gen", "gen.fasta", "a/b.c", "gen_3 length=2", "generated_20240506_070809.fasta")


def test_clean_decoded(spark):
    df = spark.createDataFrame([("[BOS] M V <fim_middle> K [EOS]",), ("[BO[EOS]S]A",), ("[EO[BOS]S]",)], "t string")
    got = [r[0] for r in df.select(T.clean_decoded(F.col("t"))).collect()]
    assert got == ["MV<fim_middle>K", "[BOS]A", ""]


def test_csv_index(spark, write):
    path = write("index.csv", "id,res\np1,1.5\np2,2\n")
    got = tables.read_csv_index(spark, [path])
    assert dict(got.dtypes)["res"] == "double"
    assert {(r["id"], r["dataset"].removeprefix("file:")) for r in got.collect()} == {("p1", path), ("p2", path)}
    typed = tables.read_csv_index(spark, [path], "id string, res string")
    assert dict(typed.dtypes)["res"] == "string"


def test_id_list_and_store_url(spark, write):
    path = write("ids.txt", "p1\n# no\np2\n\n")
    assert rows(lines.read_id_list(spark, path)) == [("p1",), ("p2",)]
    assert lines.split_store_url(f"hdfs://n/data/store#{path}") == ("hdfs://n/data/store", path)
    assert lines.split_store_url("/data/store") == ("/data/store", None)
    parts = spark.createDataFrame([("/data/store#ids",), ("/data/store",)], "u string").select(
        T.url_path(F.col("u")), T.url_fragment(F.col("u")))
    assert rows(parts) == [("/data/store", "ids"), ("/data/store", None)]


def test_read_table_pushes_the_split_down(spark, tmp_path, capsys):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "x", "train", 0), (2, "y", "eval", 0)], "id int, seq string, split string, z int").write.parquet(path)
    df = tables.read_table(spark, path, "train", text_column="seq")
    assert rows(df) == [("1", "x")]
    df.explain()
    plan = capsys.readouterr().out
    assert "EqualTo(split,train)" in plan and "z:int" not in plan


def test_idmapping_field_count(spark, write):
    path = write("map.tsv", "P1\tUniRef50\tU\nbad\tline\n")
    triples, rejects = clusters.read_idmapping(spark, path, strict=False)
    assert rows(triples) == [("P1", "UniRef50", "U")] and rejects.count() == 1
    with pytest.raises(Exception, match="three tab-separated"):
        clusters.read_idmapping(spark, path)[0].collect()


def test_batch_to_rows(spark):
    df = spark.createDataFrame([("d", [1, 2], ["a", "b"])], "dataset string, id array<int>, text array<string>")
    assert rows(tables.batch_to_rows(df, ["id", "text"])) == [("d", 1, "a"), ("d", 2, "b")]


def test_format_registry(spark, write):
    corpus = tables.read_corpus(spark, "line", [write("a.txt", "AA\n")])
    assert rows(corpus.select("text")) == [("AA",)]
    assert set(tables.READERS) == {"line", "fasta", "foldcomp", "pdb"}


def test_structure_formats_become_a_corpus(spark, tmp_path, write):
    from strandmill.plans.prepare import prepare_corpus
    from test_bpe import nested_model

    data = [("p", 1, "ALA"), ("p", 0, "GLY"), ("q", 0, "TRP"), ("r", 0, "XXX")]
    store = str(tmp_path / "store")
    spark.createDataFrame(data, "chain_id string, pos int, residue_name string").write.parquet(store)
    ids, index = write("ids.txt", "# some\np\nr\n"), write("index.csv", "id,resolution\nq,2.0\np,1.5\n")
    folded = tables.read_corpus(spark, "foldcomp", [f"{store}#{ids}"])
    assert rows(folded.select("id", "text")) == [("p", "GA"), ("r", "A")]
    indexed = tables.read_corpus(spark, "pdb", [f"{store}#{index}"])
    assert rows(indexed.select("id", "text")) == [("p", "GA"), ("q", "W")]
    assert rows(tables.read_corpus(spark, "foldcomp", [store]).select("id")) == [("p",), ("q",), ("r",)]
    assert prepare_corpus(folded, nested_model(), seed=1, max_length=16).count() == 2
    assert set(tables.TRANSFORMS) == {"foldcomp", "pdb"}

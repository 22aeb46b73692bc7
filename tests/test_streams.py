"""Streams with state, cut into micro-batches."""

import random
from collections import defaultdict

import pytest
from conftest import rows
from pyspark.sql import functions as F

from strandmill.operators import metrics as M
from strandmill.plans.catalog import QUERIES, metric_queries
from strandmill.plans.catalog.tokens import fixed_model
from strandmill.sources import fasta
from strandmill.streaming import stateful, streams

LINES = "file string, line_no long, line string"
STEPS = "phase string, step long, is_fim boolean, loss double"


@pytest.fixture
def stream(spark, tmp_path):
    """A stream of one micro-batch per list of rows."""
    def run(parts, schema):
        path = str(tmp_path / f"in-{random.random()}")
        for part in parts:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)

    return run


@pytest.fixture
def drained(spark, tmp_path):
    def run(df):
        out, progress = str(tmp_path / f"out-{random.random()}"), str(tmp_path / f"at-{random.random()}")
        streams.drain(df, out, progress)
        return spark.read.schema(df.schema).parquet(out)

    return run


def record_lines():
    rng = random.Random(4)
    out = []
    for file in ("f", "g"):
        for no in range(90):
            out.append((file, no, rng.choice([f">{file}{no}", "AC", "GGT", "", "é "])))
    return out


def parts_of(lines, n):
    """The lines in n micro-batches, each file in order from one to the next, shuffled inside."""
    rng = random.Random(5)
    parts = [[x for x in lines if x[1] * n // 90 == k] for k in range(n)]
    for part in parts:
        rng.shuffle(part)
    return parts


@pytest.mark.parametrize("n", [1, 5])
def test_records_over_micro_batches(spark, stream, drained, n):
    lines = record_lines()
    parts = parts_of(lines, n)
    parts[-1] += [("f", 90, None), ("g", 90, None)]
    # A replayed micro-batch changes nothing.
    parts.insert(1, list(parts[0]))
    got = drained(stateful.stream_records(stream(parts, LINES)))
    want = fasta.segment_lines(spark.createDataFrame(lines, LINES))
    assert rows(got.select("file", "id", "text")) == rows(want.select("file", "id", "text"))
    numbers = {r.id: r.record_no for r in got.collect() if r.id}
    heads = [x[2][1:] for x in lines if x[0] == "f" and x[2].startswith(">")]
    assert all(numbers[h] == i + 1 for i, h in enumerate(heads) if h in numbers)


def test_open_records_wait(stream, drained):
    got = drained(stateful.stream_records(stream([[("f", 1, ">a"), ("f", 2, "X")], [("f", 3, "Y")]], LINES)))
    assert rows(got) == []


@pytest.mark.parametrize("n", [1, 4])
def test_row_ids_over_micro_batches(stream, drained, n):
    lines = record_lines()
    parts = parts_of(lines, n)
    parts.append(list(parts[0]))
    got = drained(stateful.stream_row_ids(stream(parts, LINES)))
    want = []
    for file in ("f", "g"):
        kept = [(x[1], x[2].strip()) for x in lines if x[0] == file and x[2].strip()]
        want += [(file, no, i, text) for i, (no, text) in enumerate(kept)]
    assert rows(got) == sorted(want, key=repr)


def step_rows(n_steps=60):
    rng = random.Random(6)
    return [(phase, s, rng.random() < (0.0 if s % 7 == 0 else 0.4), None if rng.random() < 0.05 else rng.random())
            for phase in ("train", "eval") for s in range(n_steps) for _ in range(rng.randint(1, 6))]


def by_interval(spark, data):
    rolled = M.metric_rollup(M.metric_loss_by_tag(spark.createDataFrame(data, STEPS)), 10)
    return {(r.phase, r.interval): tuple(None if v is None else round(v, 9) for v in r[2:]) for r in rolled.collect()}


def emitted(df):
    return {(r.phase, r.interval): tuple(None if v is None or v != v else round(v, 9) for v in r[2:6]) for r in df.collect()}


@pytest.mark.parametrize("slack", [0, 15])
def test_step_intervals_equal_the_roll_up(spark, stream, drained, slack):
    data = step_rows()
    parts = [[r for r in data if r[1] // 16 == k] for k in range(4)]
    if slack:
        # Steps that come up to 15 steps late still count.
        parts[2] += [r for r in parts[1] if r[1] >= 28]
        parts[1] = [r for r in parts[1] if r[1] < 28]
    parts[-1] += [("train", None, None, None), ("eval", None, None, None)]
    got = drained(stateful.stream_metric_steps(stream(parts, STEPS), 10, slack)).cache()
    assert emitted(got) == by_interval(spark, data)
    assert {r.late_rows for r in got.collect()} == {0}


def test_late_steps_are_counted_and_left_out(spark, stream, drained):
    data = step_rows(30)
    late = [("train", 3, True, 9.0), ("train", 4, False, 9.0)]
    open_end = [r for r in data if r[1] >= 20]
    parts = [[r for r in data if r[1] < 15], [r for r in data if r[1] >= 15] + late, [("eval", None, None, None)]]
    got = drained(stateful.stream_metric_steps(stream(parts, STEPS), 10)).cache()
    found = emitted(got)
    want = by_interval(spark, data)
    # The last interval of a phase that has not ended is still open.
    assert found == {k: v for k, v in want.items() if k != ("train", 2)}
    counted = {(r.phase, r.interval): r.late_rows for r in got.collect()}
    assert counted[("train", 1)] == 2 and sum(counted.values()) == 2 and open_end


def test_tokens_of_a_replayed_micro_batch(spark, stream, tmp_path):
    texts = [[(f"{k}{i}", "the end and the other " * (1 + i % 3)) for i in range(10)] for k in range(3)]
    path, progress = str(tmp_path / "tokens"), str(tmp_path / "progress")
    options = {"seed": 1, "fim_rate": 0.5, "batch_size": 4}
    source = stream(texts, "id string, text string")
    streams.stream_tokens(source, fixed_model(), path, progress, **options)
    written = spark.read.parquet(path)
    assert written.select("micro_batch").distinct().count() == 3 and written.count() == 30
    before = rows(written.select("micro_batch", "batch_id", "id", "input_ids", "labels", "attention_mask"))
    writer = streams.token_writer(fixed_model(), path, **options)
    writer(spark.createDataFrame(texts[1], "id string, text string"), 1)
    again = spark.read.parquet(path)
    assert rows(again.select("micro_batch", "batch_id", "id", "input_ids", "labels", "attention_mask")) == before
    for r in again.collect():
        assert len(r.input_ids) == len(r.labels) == len(r.attention_mask)
    widths = again.groupBy("micro_batch", "batch_id").agg({"input_ids": "count"}).collect()
    assert sorted(r[2] for r in widths) == [2, 2, 2, 4, 4, 4, 4, 4, 4]
    # Nothing that is there already is read again.
    streams.stream_tokens(source, fixed_model(), path, progress, **options)
    assert spark.read.parquet(path).count() == 30


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
DOC_ROWS = [(i, f"the end of {i} " * (1 + i % 5), "en", f"src{i % 3}", 0) for i in range(40)]


@pytest.mark.parametrize("name", ["stream_tokens", "stream_prepare"])
def test_streams_of_tables_that_are_folders(spark, tmp_path, name):
    file, folder = tmp_path / "file", tmp_path / "folder"
    docs = spark.createDataFrame(DOC_ROWS, DOCS)
    docs.repartition(3).write.parquet(str(folder / "documents.parquet"))
    docs.coalesce(1).write.parquet(str(tmp_path / "one"))
    file.mkdir()
    next((tmp_path / "one").glob("part-*")).rename(file / "documents.parquet")
    found = [rows(QUERIES[name](spark, str(d))) for d in (file, folder)]
    assert len(found[0]) == len(DOC_ROWS) and found[0] == found[1]


def test_parts_are_cut_by_size(spark, monkeypatch):
    """Keys lie far apart; a part holds a bounded share of the bytes, and is written by several tasks."""
    monkeypatch.setattr(metric_queries, "PART_BYTES", 2000)
    keys = [*range(50), *range(10**9, 10**9 + 50), -5]
    docs = spark.createDataFrame([(k, "x" * (k % 7 * 30)) for k in keys] + [(3, "twice"), (None, "none")], "k long, text string")
    parts = [p.collect() for p in metric_queries._parts(spark, docs, "k", F.length("text") + 64, "parts")]
    assert len(parts) > metric_queries.PARTS
    assert sorted((r.k, r.text) for p in parts for r in p) == sorted((r.k, r.text) for r in docs.collect() if r.k is not None)
    assert all(max(r.k for r in a) < min(r.k for r in b) for a, b in zip(parts, parts[1:]))
    assert max(sum(len(r.text) + 64 for r in p) for p in parts) < 2000 + 2 * (6 * 30 + 64)


@pytest.mark.parametrize("name", ["stream_fasta", "stream_row_id"])
def test_streams_in_more_micro_batches(spark, tmp_path, monkeypatch, name):
    spark.createDataFrame([(i * i * i, *rest) for i, *rest in DOC_ROWS], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    want = rows(QUERIES[name](spark, str(tmp_path)))
    monkeypatch.setattr(metric_queries, "PART_BYTES", 800)
    assert rows(QUERIES[name](spark, str(tmp_path))) == want and len(want) >= len(DOC_ROWS)

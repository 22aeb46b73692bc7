"""Metric roll-ups and streams over the events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmill.functions.text import wrap_lines
from strandmill.operators import metrics as M
from strandmill.operators.rowid import running_total
from strandmill.plans.catalog.corpus import _SEQ_SQL, DOC_LINES_SQL, _sequences, _write_lines
from strandmill.plans.catalog.padded import padded_sql, padded_text
from strandmill.plans.catalog.registry import (
    DOCS_SQL, SEED, query, sql_arranged, sql_wrap, table,
)
from strandmill.plans.catalog.tokens import fixed_model
from strandmill.session import fresh_path
from strandmill.streaming import stateful, streams

ROWS_PER_STEP = 32
LOGGING_STEPS = 10
WIDTH = "6 hours"
LATENESS = "1 hour"


def _rows(events):
    """Events as training rows: 32 to a step, clicks as FIM rows, sign-ups as evaluation."""
    return events.select(
        F.expr(f"event_id div {ROWS_PER_STEP}").alias("step"), "ts",
        F.when(F.col("event_type") == "signup", "eval").otherwise("train").alias("phase"),
        (F.col("event_type") == "click").alias("is_fim"), F.col("value").alias("loss"),
    )


def _round(name: str):
    """Six places; the small shift keeps values on a tie from going either way."""
    return F.round(F.col(name) + F.lit(1e-9), 6).alias(name)


def _round_sql(x: str, name: str) -> str:
    return f"round({x} + 1e-9, 6) AS {name}"


_ROWS_SQL = f"""
    SELECT event_id // {ROWS_PER_STEP} AS step, ts, CASE WHEN event_type = 'signup' THEN 'eval' ELSE 'train' END AS phase,
           event_type = 'click' AS is_fim, value AS loss FROM events
"""
_COUNTS_SQL = f"""
    SELECT phase, step, count(*) FILTER (is_fim) AS n_fim, count(*) FILTER (NOT is_fim) AS n_std,
           avg(loss) AS loss FROM ({_ROWS_SQL}) GROUP BY phase, step
"""
_BY_TAG_SQL = f"""
    SELECT phase, step, n_fim, n_std,
           CASE WHEN n_fim > 0 THEN loss * n_fim / (n_fim + n_std) END AS loss_fim,
           CASE WHEN n_std > 0 THEN loss * n_std / (n_fim + n_std) END AS loss_std
    FROM ({_COUNTS_SQL})
"""


@query("metric_counts", f"SELECT phase, step, n_fim, n_std FROM ({_COUNTS_SQL})")
def metric_counts(spark, sf_dir):
    return M.metric_counts(_rows(table(spark, sf_dir, "events")))


@query("metric_loss_by_tag", f"""
    SELECT phase, step, n_fim, n_std, {_round_sql('loss_fim', 'loss_fim')}, {_round_sql('loss_std', 'loss_std')}
    FROM ({_BY_TAG_SQL})
""")
def metric_loss_by_tag(spark, sf_dir):
    rows = M.metric_loss_by_tag(_rows(table(spark, sf_dir, "events")))
    return rows.select("phase", "step", "n_fim", "n_std", _round("loss_fim"), _round("loss_std"))


@query("metric_rollup", f"""
    SELECT phase, step // {LOGGING_STEPS} AS "interval", {', '.join(
        _round_sql(f'avg({m})', m) for m in ('n_fim', 'n_std', 'loss_fim', 'loss_std'))}
    FROM ({_BY_TAG_SQL}) GROUP BY phase, step // {LOGGING_STEPS}
""")
def metric_rollup(spark, sf_dir):
    per_step = M.metric_loss_by_tag(_rows(table(spark, sf_dir, "events")))
    rolled = M.metric_rollup(per_step, LOGGING_STEPS)
    return rolled.select(
        "phase", "interval", *[_round(m) for m in ("n_fim", "n_std", "loss_fim", "loss_std")]
    )


def _window_columns(windows):
    return windows.select(
        F.col("window_start").cast("string").alias("window_start"), "tag", _round("loss"), "n"
    )


_WINDOW_SQL = f"""
    SELECT time_bucket(INTERVAL '{WIDTH}', ts) AS ws, CASE WHEN is_fim THEN 'fim' ELSE 'std' END AS tag,
           avg(loss) AS loss, count(*) AS n FROM ({_ROWS_SQL}) GROUP BY ws, tag
"""
_WINDOW_OUT = f"CAST(ws AS VARCHAR) AS window_start, tag, {_round_sql('loss', 'loss')}, n"


@query("metric_window", f"SELECT {_WINDOW_OUT} FROM ({_WINDOW_SQL})")
def metric_window(spark, sf_dir):
    return _window_columns(M.metric_windows(_rows(table(spark, sf_dir, "events")), WIDTH))


def _stream_table(spark, sf_dir, name):
    """The table as a stream, be it a file or a folder of files; a stream takes one file only as a pattern."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{{{name}}}.parquet")


def _drained(spark, stream, name):
    path = fresh_path(spark, name)
    streams.drain(stream, path, fresh_path(spark, f"{name}-progress"))
    return spark.read.schema(stream.schema).parquet(path)


@query("metric_window_stream", f"""
    SELECT CAST(epoch(ws) AS BIGINT) AS window_start, tag, {_round_sql('loss', 'loss')}, n FROM ({_WINDOW_SQL})
    WHERE ws + INTERVAL '{WIDTH}' <= (SELECT max(ts) FROM events) - INTERVAL '{LATENESS}'
""")
def metric_window_stream(spark, sf_dir):
    """The windows that have closed by the end of the stream, starts in epoch seconds."""
    # The table's times carry no zone, which a watermark needs; they are taken as UTC.
    utc = F.to_timestamp(F.concat(F.col("ts").cast("string"), F.lit("Z")))
    rows = _rows(_stream_table(spark, sf_dir, "events")).withColumn("ts", utc)
    windows = _drained(spark, streams.stream_metric_windows(rows, WIDTH, LATENESS), "windows")
    return windows.select(
        F.col("window_start").cast("bigint").alias("window_start"), "tag", _round("loss"), "n"
    )


MAX_LENGTH = 512
_ARRANGED_SQL = sql_arranged(DOCS_SQL, 0.5, 0.5, MAX_LENGTH, wrap=True)


@query("stream_prepare", f"SELECT id, text, is_fim FROM ({_ARRANGED_SQL})")
def stream_prepare(spark, sf_dir):
    """The text part of the training transform on a stream of documents."""
    lines = _stream_table(spark, sf_dir, "documents").selectExpr("cast(doc_id as string) id", "text")
    arranged = streams.stream_prepare(lines, seed=SEED, max_length=MAX_LENGTH, fim_rate=0.5)
    return _drained(spark, arranged, "prepared")


@query("stream_lines", f"SELECT text, count(*) AS n FROM ({DOC_LINES_SQL}) GROUP BY text")
def stream_lines(spark, sf_dir):
    """Lines of text files as a stream; ids depend on file names, so lines are counted."""
    lines = streams.stream_lines(spark, _write_lines(spark, sf_dir))
    return _drained(spark, lines, "stream-lines").groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query("stream_tokens", padded_sql(sql_arranged(
    f"SELECT *, row_number() OVER (ORDER BY id) - 1 AS example FROM ({DOCS_SQL})", 0.5, 0.5, 64, True, keep="example,"), 8, "id"))
def stream_tokens(spark, sf_dir):
    """Documents as a stream, written as padded batches."""
    lines = _stream_table(spark, sf_dir, "documents").selectExpr("cast(doc_id as string) id", "text")
    path = fresh_path(spark, "stream-tokens")
    streams.stream_tokens(
        lines, fixed_model(), path, fresh_path(spark, "stream-tokens-progress"), batch_size=8,
        seed=SEED, max_length=64, fim_rate=0.5,
    )
    return padded_text(spark.read.parquet(path))


# Micro-batches that the streams below are cut into: so many, or more where one would hold more bytes.
PARTS = 4
PART_BYTES = 256 << 20
# Bytes that a row counts besides its text.
ROW_BYTES = 64


def _parts(spark, rows, order: str, size, name: str):
    """The rows in parts that follow each other in ``order``, of about the same sum of ``size``.

    Rows of one value of ``order`` stay together; rows without one are left out. The driver gets one
    value per part.
    """
    rows = rows.where(F.col(order).isNotNull())
    sizes = rows.groupBy(order).agg(F.sum(size).alias("size"))
    placed = running_total(sizes, [order], "size", "before")
    total = placed.agg(F.max(F.col("before") + F.col("size"))).first()[0] or 0
    most = max(1, min(PART_BYTES, -(-total // PARTS)))
    starts = placed.groupBy(F.expr(f"before div {most}")).agg(F.min(order)).collect()
    cuts = F.array(*[F.lit(first).cast("bigint") for _, first in sorted(starts)[1:]])
    part = F.size(F.filter(cuts, lambda first: first <= F.col(order)))
    tasks = max(spark.sparkContext.defaultParallelism, 2 * len(starts))
    dealt = rows.withColumn("part", part).repartitionByRange(tasks, order)
    path = fresh_path(spark, name)
    dealt.write.partitionBy("part").parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)
    return [dealt.where(F.col("part") == k).drop("part") for k in range(max(1, len(starts)))]


def _drained_by_part(spark, parts, run, name: str):
    """What ``run`` makes of a stream to which one part after another comes, each a micro-batch."""
    path, arrived, progress = (fresh_path(spark, f"{name}{x}") for x in ("", "-arrived", "-progress"))
    for part in parts:
        part.write.mode("append").parquet(arrived)
        stream = run(spark.readStream.schema(part.schema).parquet(arrived))
        streams.drain(stream, path, progress)
    return spark.read.schema(stream.schema).parquet(path)


@query("metric_steps_stream", f"""
    SELECT phase, step // {LOGGING_STEPS} AS "interval", {', '.join(
        _round_sql(f'avg({m})', m) for m in ('n_fim', 'n_std', 'loss_fim', 'loss_std'))}, count(*) AS n_steps, 0 AS late_rows
    FROM ({_BY_TAG_SQL}) GROUP BY phase, step // {LOGGING_STEPS}
""")
def metric_steps_stream(spark, sf_dir):
    """The roll-up by step intervals, from rows that come in parts; a null step ends a phase."""
    rows = _rows(table(spark, sf_dir, "events")).drop("ts")
    ends = rows.select("phase").distinct().select(
        F.lit(None).cast("bigint").alias("step"), "phase", F.lit(None).cast("boolean").alias("is_fim"),
        F.lit(None).cast("double").alias("loss"),
    )
    parts = _parts(spark, rows, "step", F.lit(ROW_BYTES), "steps")
    parts[-1] = parts[-1].unionByName(ends)
    steps = _drained_by_part(
        spark, parts, lambda stream: stateful.stream_metric_steps(stream, LOGGING_STEPS), "metric-steps"
    )
    return steps.select(
        "phase", "interval", *[_round(m) for m in ("n_fim", "n_std", "loss_fim", "loss_std")], "n_steps", "late_rows"
    )


def _record_lines(spark, sf_dir, ended: bool):
    """Lines of FASTA records, a file per source, in parts; the documents of a part come in order."""
    rows = _sequences(spark, sf_dir).select("source", "doc_id", "id", "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES
    pieces = F.concat(F.array(F.concat(F.lit(">"), "id")), F.split(wrap_lines(F.col("text")), "\n"))
    parts = [
        part.select(F.col("source").alias("file"), "doc_id", F.posexplode(pieces).alias("pos", "line")).select(
            "file", (F.col("doc_id") * F.lit(1 << 24) + F.col("pos")).alias("line_no"), "line"
        )
        for part in _parts(spark, rows, "doc_id", size, "records")
    ]
    if ended:
        last = rows.agg(F.max("doc_id")).first()[0] or 0
        parts[-1] = parts[-1].unionByName(rows.select("source").distinct().select(
            F.col("source").alias("file"), F.lit((last + 1) << 24).cast("bigint").alias("line_no"),
            F.lit(None).cast("string").alias("line"),
        ))
    return parts


@query("stream_fasta", f"""
    SELECT file, record_no, id, text FROM (
      SELECT source AS file, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS record_no, id, text
      FROM ({_SEQ_SQL}))
    WHERE text <> ''
""")
def stream_fasta(spark, sf_dir):
    """Records whose lines come in several micro-batches."""
    return _drained_by_part(spark, _record_lines(spark, sf_dir, True), stateful.stream_records, "stream-records")


@query("stream_row_id", f"""
    SELECT source AS file, row_number() OVER (PARTITION BY source ORDER BY doc_id, pos) - 1 AS id, line AS text FROM (
      SELECT source, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (
        SELECT source, doc_id, list_concat(['>' || id], string_split({sql_wrap('text')}, chr(10))) AS ls FROM ({_SEQ_SQL})))
    WHERE line <> ''
""")
def stream_row_id(spark, sf_dir):
    """Running ids of lines that come in several micro-batches."""
    lines = _record_lines(spark, sf_dir, False)
    return _drained_by_part(spark, lines, stateful.stream_row_ids, "stream-row-ids").select("file", "id", "text")

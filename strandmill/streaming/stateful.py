"""Streams with state: running ids and records of lines, and metrics by step intervals.

State is kept per file or phase. Lines of a file, and steps of a phase, may come in any number of
micro-batches; a row without a line, or without a step, says that the file or phase is over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandmill.functions.text import strip

LINE_STATE = "last bigint, seen bigint, header string, body string, begun boolean"


def _new_lines(frames: Iterator[pd.DataFrame], last: int) -> pd.DataFrame:
    """Lines after the last one seen, in order; replayed lines are left out."""
    rows = pd.concat(list(frames)).sort_values("line_no", kind="stable")
    return rows[rows["line_no"] > last].drop_duplicates("line_no")


def _by_file(lines: DataFrame, file: str, line_no: str, text, run: Callable, out: str, state: str) -> DataFrame:
    rows = lines.select(
        F.col(file).cast("string").alias("file"), F.col(line_no).cast("bigint").alias("line_no"), text.alias("line")
    )
    return rows.groupBy("file").applyInPandasWithState(
        run, out, state, "append", GroupStateTimeout.NoTimeout
    )


def stream_row_ids(
    lines: DataFrame, file: str = "file", line_no: str = "line_no", text: str = "line"
) -> DataFrame:
    """Stripped non-blank lines with a 0-based id running over each file: ``file, line_no, id, text``.

    Lines of a file come in order from one micro-batch to the next; one whose number is not
    above all earlier ones is a replay and is left out. The state is two numbers per file.
    """
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, seen = state.get if state.exists else (-1, 0)
        rows = _new_lines(frames, last)
        if len(rows):
            last = int(rows["line_no"].iloc[-1])
        kept = rows[rows["line"].fillna("") != ""]
        state.update((last, seen + len(kept)))
        yield pd.DataFrame({
            "file": key[0], "line_no": kept["line_no"].to_numpy(),
            "id": seen + np.arange(len(kept)), "text": kept["line"].to_numpy(),
        })

    return _by_file(
        lines, file, line_no, strip(F.col(text)), run,
        "file string, line_no bigint, id bigint, text string", "last bigint, seen bigint",
    )


def stream_records(
    lines: DataFrame, file: str = "file", line_no: str = "line_no", text: str = "line"
) -> DataFrame:
    """FASTA records of a stream of lines: ``file, record_no, id, text``; empty ones are left out.

    A record is complete with the next header of its file, or with a null line that ends the file.
    The open record is kept between micro-batches, so one record must fit in memory. Record numbers
    count headers in a file; text before the first has number 0. Replays are left out as in
    ``stream_row_ids``.
    """
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, seen, header, body, begun = state.get if state.exists else (-1, 0, "", "", False)
        rows = _new_lines(frames, last)
        pieces, out = [body], []

        def close() -> None:
            whole = "".join(pieces)
            if begun and whole:
                out.append((key[0], seen, header, whole))

        for number, line in zip(rows["line_no"].tolist(), rows["line"].tolist()):
            last = number
            if line is None or line != line:
                close()
                pieces, begun = [], False
            elif line.startswith(">"):
                close()
                seen, header, pieces, begun = seen + 1, line[1:], [], True
            else:
                begun = True
                pieces.append(line)
        state.update((last, seen, header, "".join(pieces), begun))
        yield pd.DataFrame(out, columns=["file", "record_no", "id", "text"])

    return _by_file(
        lines, file, line_no, F.col(text), run,
        "file string, record_no bigint, id string, text string", LINE_STATE,
    )


STEP_STATE = (
    "steps array<bigint>, n_fim array<bigint>, n_std array<bigint>, losses array<double>, "
    "n_losses array<bigint>, open bigint, late bigint"
)
STEP_ROWS = (
    "phase string, interval bigint, n_fim double, n_std double, loss_fim double, loss_std double, "
    "n_steps bigint, late_rows bigint"
)
_SUMS = ["n_fim", "n_std", "losses", "n_losses"]


def _interval_row(steps: pd.DataFrame) -> list:
    """Means over the steps of an interval; a step without rows of a tag has no loss for it."""
    loss = steps["losses"] / steps["n_losses"].where(steps["n_losses"] > 0)
    size = steps["n_fim"] + steps["n_std"]
    shares = [(loss * steps[n] / size).where(steps[n] > 0).mean() for n in ("n_fim", "n_std")]
    return [steps["n_fim"].mean(), steps["n_std"].mean(), *shares, len(steps)]


def stream_metric_steps(
    rows: DataFrame, logging_steps: int = 10, slack: int = 0, loss: str = "loss"
) -> DataFrame:
    """Metrics by step intervals as the rows of a stream come: ``STEP_ROWS``.

    ``rows`` has phase, step, is_fim and a loss. An interval is emitted, and its steps forgotten, once
    a step lies ``slack`` steps or more behind its end, or when a null step ends the phase. Rows of an
    interval that is out already change nothing; the next interval of the phase says how many came.
    The state holds a few sums for each step of the open intervals.
    """
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            *lists, first_open, late = state.get
            sums = pd.DataFrame(dict(zip(["step", *_SUMS], map(list, lists))))
        else:
            sums, first_open, late = pd.DataFrame({c: [] for c in ["step", *_SUMS]}), 0, 0
        over, parts = False, [sums]
        for frame in frames:
            over |= bool(frame["step"].isna().any())
            frame = frame[frame["step"].notna()]
            behind = frame["step"] // logging_steps < first_open
            late += int(behind.sum())
            frame = frame[~behind]
            fim = frame["is_fim"].eq(True)
            parts.append(pd.DataFrame({
                "step": frame["step"], "n_fim": fim.astype("int64"), "n_std": (~fim).astype("int64"),
                "losses": frame["loss"].fillna(0.0), "n_losses": frame["loss"].notna().astype("int64"),
            }))
        sums = pd.concat([p for p in parts if len(p)] or parts[:1]).groupby("step", as_index=False)[_SUMS].sum()
        interval = (sums["step"] // logging_steps).astype("int64")
        if len(sums):
            newest = int(sums["step"].max())
            closed = newest // logging_steps + 1 if over else (newest - slack) // logging_steps
            first_open = max(first_open, closed)
        out = []
        for number, steps in sums[interval < first_open].groupby(interval[interval < first_open]):
            out.append([key[0], number, *_interval_row(steps), late])
            late = 0
        sums = sums[interval >= first_open]
        state.update((
            *(sums[c].astype("int64").tolist() if c != "losses" else sums[c].astype(float).tolist()
              for c in ["step", *_SUMS]), first_open, late,
        ))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in STEP_ROWS.split(", ")])

    wanted = rows.select(
        F.col("phase").cast("string").alias("phase"), F.col("step").cast("bigint").alias("step"), "is_fim",
        F.col(loss).cast("double").alias("loss"),
    )
    return wanted.groupBy("phase").applyInPandasWithState(
        run, STEP_ROWS, STEP_STATE, "append", GroupStateTimeout.NoTimeout
    )

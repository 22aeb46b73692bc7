"""Language identification: sparse multinomial logistic regression on character n-grams.

Features are hashed n-grams of one to four characters within words, weighted by TF-IDF.
Document frequencies cover all rows that may be learnt from. Weights are fitted on a bounded
sample by follow-the-regularised-leader with L1 and L2 penalties; a temperature fitted on the
rest of the sample makes scores match accuracy.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.text_arrays import column_texts, text_slices

FEATURE_BITS = 14
N_FEATURES = 1 << FEATURE_BITS
ORDERS = 4
SLICE_BYTES = 2 << 20
#: Characters of one text that are looked at together; a cut falls on white space if it can.
SEGMENT = 1 << 20
DENSE_ROWS = 128
UNKNOWN = "und"
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` bounds the rows that weights and temperature are fitted on."""

    sample_rows: int = 6000
    epochs: int = 4
    batch: int = 32
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.01


@dataclass(frozen=True)
class Model:
    classes: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


# ---------------------------------------------------------------------- features


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _segments(text: str) -> Iterator[str]:
    """The text in parts; n-grams never span white space, so cuts there lose none."""
    start = 0
    while len(text) - start > SEGMENT:
        stop = start + SEGMENT
        cut = max(text.rfind(" ", start, stop), text.rfind("\n", start, stop))
        stop = cut + 1 if cut > start else stop
        yield text[start:stop]
        start = stop
    yield text[start:]


def _cells(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and feature of every n-gram of short texts, and which texts have a letter."""
    lowered = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le"), np.uint32)
    rows = np.repeat(np.arange(len(texts)), np.fromiter(map(len, lowered), np.int64, len(texts)))
    letter = _letters()[codes]
    again = np.zeros(len(codes), bool)
    again[1:] = ~letter[1:] & ~letter[:-1] & (rows[1:] == rows[:-1])
    letter, rows = letter[~again], rows[~again]
    codes = np.where(letter, codes[~again], np.uint32(32))
    found_rows, found = [], []
    total = np.zeros(len(codes), np.uint32)
    inner = np.ones(len(codes), bool)
    for order in range(1, ORDERS + 1):
        count = len(codes) - order + 1
        if count <= 0:
            break
        total = total[:count] * np.uint32(0x01000193) + codes[order - 1:] + np.uint32(order)
        if order > 2:
            inner = inner[:count] & letter[order - 2:order - 2 + count]
        ok = inner[:count]
        if order <= 2:
            ok = ok & (letter[:count] | letter[order - 1:])
        hashed = (total ^ (total >> np.uint32(15))) * np.uint32(0x9E3779B1)
        found.append((hashed[ok] >> np.uint32(32 - FEATURE_BITS)).astype(np.int64))
        found_rows.append(rows[:count][ok])
    has = np.bincount(rows[letter], minlength=len(texts)) > 0
    return np.concatenate(found_rows), np.concatenate(found), has


def count_chunks(texts: list[str]) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Counts of features in blocks of texts: (which texts, counts, which have a letter)."""
    for start in range(0, len(texts), DENSE_ROWS):
        block = texts[start:start + DENSE_ROWS]
        counts = np.zeros(len(block) * N_FEATURES)
        has = np.zeros(len(block), bool)
        parts = [(i, part) for i, t in enumerate(block) for part in _segments(t)]
        while parts:
            size, used = 0, 0
            while used < len(parts) and (not used or size + len(parts[used][1]) <= SEGMENT):
                size += len(parts[used][1])
                used += 1
            now, parts = parts[:used], parts[used:]
            owner = np.array([i for i, _ in now])
            rows, features, letters = _cells([part for _, part in now])
            counts += np.bincount(owner[rows] * N_FEATURES + features, minlength=len(counts))
            has[owner[letters]] = True
        yield slice(start, start + len(block)), counts.reshape(len(block), N_FEATURES), has


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


# ---------------------------------------------------------------------- learning


def learnable(docs: DataFrame) -> DataFrame:
    """Rows (key, text, lang) to learn from: language known, remainder of the id's crc not 1."""
    return docs.where(
        "lang is not null and text is not null and pmod(crc32(cast(doc_id as string)), 3) <> 1"
    ).select(F.xxhash64(F.col("doc_id").cast("string")).alias("key"), "text", "lang")


def document_frequencies(rows: DataFrame) -> DataFrame:
    """Rows (feature, df, n): texts that have the feature; feature -1 has their number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(N_FEATURES, np.int64), 0
        for batch in text_slices(batches, max_bytes=SLICE_BYTES):
            for _, counts, _ in count_chunks(column_texts(batch).to_pylist()):
                df += (counts > 0).sum(0)
                n += len(counts)
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(found, -1)), pa.array(np.append(df[found], n))],
            names=["feature", "df"],
        )

    return rows.select("text").mapInArrow(run, "feature long, df long").groupBy("feature").agg(
        F.sum("df").alias("df")
    )


def sample(rows: DataFrame, sample_rows: int) -> tuple[DataFrame, list[str]]:
    """At most ``sample_rows`` rows, about as many per language, chosen by a hash of the id."""
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    classes = sorted(counts)
    share = sample_rows / max(1, len(classes))
    chance = F.lit(0.0)
    for lang in classes:
        chance = F.when(F.col("lang") == lang, min(1.0, share / counts[lang])).otherwise(chance)
    place = (F.col("key") / F.lit(2.0**64)) + 0.5
    return rows.where(place < chance).orderBy("key", "lang", "text").limit(sample_rows), classes


def fit_weights(
    x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_classes: int, settings: Settings
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by per-coordinate FTRL-proximal over small batches, in the given order."""
    shape = (N_FEATURES + 1, n_classes)
    z, n, w = np.zeros(shape), np.zeros(shape), np.zeros(shape)
    for _ in range(settings.epochs):
        for start in range(0, len(x), settings.batch):
            stop = min(len(x), start + settings.batch)
            dense = np.zeros((stop - start, N_FEATURES + 1))
            dense[:, -1] = 1
            for i, (at, values) in enumerate(x[start:stop]):
                dense[i, at] = values
            p = softmax(dense @ w)
            p[np.arange(stop - start), y[start:stop]] -= 1
            g = dense.T @ p
            sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / settings.alpha
            z += g - sigma * w
            n += g * g
            w = -np.sign(z) * np.maximum(np.abs(z) - settings.l1, 0)
            w /= (settings.beta + np.sqrt(n)) / settings.alpha + settings.l2
    return w[:-1], w[-1]


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature between 0.05 and 20 under which the true classes are likeliest."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 241))
    losses = [
        -np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid
    ]
    return float(grid[int(np.argmin(losses))])


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model | None:
    """A model of ``docs`` (doc_id, text, lang), or None where there is nothing to learn from."""
    rows = learnable(docs)
    chosen, classes = sample(rows, settings.sample_rows)
    if not classes:
        return None
    frequencies = {r.feature: r.df for r in document_frequencies(rows).collect()}
    n_docs = frequencies.pop(-1)
    df = np.zeros(N_FEATURES)
    df[list(frequencies)] = list(frequencies.values())
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    number = {lang: i for i, lang in enumerate(classes)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sparse, y = [], []
        for batch in text_slices(batches, max_bytes=SLICE_BYTES):
            for _, counts, _ in count_chunks(column_texts(batch).to_pylist()):
                for row in weigh(counts, idf):
                    at = np.flatnonzero(row)
                    sparse.append((at.astype(np.int32), row[at].astype(np.float32)))
            y += [number[v] for v in batch.column("lang").to_pylist()]
        y = np.array(y, np.int64)
        tune = np.arange(len(y)) % 5 == 4
        train = [v for v, t in zip(sparse, tune) if not t]
        w, b = fit_weights(train, y[~tune], len(classes), settings)
        held = [v for v, t in zip(sparse, tune) if t]
        logits = np.array([values @ w[at] + b for at, values in held]).reshape(-1, len(classes))
        found = [
            w.astype("<f8").tobytes(), b.astype("<f8").tobytes(), fit_temperature(logits, y[tune]),
        ]
        yield pa.RecordBatch.from_pydict(dict(zip(("w", "b", "t"), ([v] for v in found))))

    # The sample is bounded, so one task may fit it.
    fitted = (
        chosen.repartition(1).sortWithinPartitions("key", "lang", "text")
        .mapInArrow(run, "w binary, b binary, t double").first()
    )
    weights = np.frombuffer(fitted.w, "<f8").reshape(N_FEATURES, len(classes))
    return Model(classes, idf, weights, np.frombuffer(fitted.b, "<f8"), fitted.t)


# ---------------------------------------------------------------------- prediction


def predict_texts(texts: list[str], model: Model | None) -> tuple[list[str], np.ndarray]:
    langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if model is None:
        return langs, scores
    for where, counts, has in count_chunks(texts):
        p = softmax((weigh(counts, model.idf) @ model.weights + model.bias) / model.temperature)
        best = p.argmax(1)
        for i in np.flatnonzero(has):
            langs[where.start + i] = model.classes[best[i]]
            scores[where.start + i] = p[i, best[i]]
    return langs, scores


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score), one per document.

    A null text, an empty one and one without a letter are ``und`` with score 0; so is all
    where nothing could be learnt. A null id is not held out, and not learnt from. Repeated
    ids are rows of their own. Only doc_id and text are looked at.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, max_bytes=SLICE_BYTES):
            langs, scores = predict_texts(column_texts(batch).to_pylist(), model)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("held_out"),
                    pa.array(langs, pa.string()), pa.array(scores),
                ],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    held = F.coalesce(F.expr("pmod(crc32(cast(doc_id as string)), 3) = 1"), F.lit(False))
    return docs.select(
        F.col("doc_id").cast("long"), held.alias("held_out"), "text"
    ).mapInArrow(run, PREDICTED)

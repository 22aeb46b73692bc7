"""Small tables, and plain Python versions of what operators compute."""

from __future__ import annotations

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that clash with names the operators use themselves.
CLASH = ", kept string, key string, n string, token string, grams string, host string, hi long"
WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def docs_of(spark, texts, clash: bool = False, parts: int = 3):
    """Documents (id, text) or texts numbered from 0, with null and clashing columns on request."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    rows = [(i, t, None, None, None if t is None else len(t)) for i, t in rows]
    schema = DOCS + CLASH if clash else DOCS
    rows = [r + ("x", None, "y", "z", "g", "h", 7) for r in rows] if clash else rows
    return spark.createDataFrame(rows, schema).repartition(parts) if rows else spark.createDataFrame([], schema)


def prose(seed: int, n_words: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n_words))


def edited(text: str, seed: int, edits: int) -> str:
    rng = random.Random(seed)
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def lower_ascii(text: str) -> bytes:
    return text.encode().lower()


def shingles(text: str | None, width: int = 5) -> list[tuple[bytes, ...]]:
    words = WORD.findall(lower_ascii(text or ""))
    if len(words) < width:
        return [tuple(words)] if words else []
    return [tuple(words[i:i + width]) for i in range(len(words) - width + 1)]


def by_id(df, *columns):
    return {r[0]: tuple(r[1:]) for r in df.select("doc_id", *columns).collect()}

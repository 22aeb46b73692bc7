"""Rearranging by piece tables against plain strings."""

import hashlib
import re

import pyarrow as pa
import pytest
from helpers import docs_of, prose

from strandmill.llm import fim_pieces, text_arrays


def plainly(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[i:i + 8], 16) for i in range(0, 32, 8))
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [
    "", None, "a", "é", "one two", "a<P>b", "x <S", "<", "<P", "ab<M>", "P>", "<<P>>", "\n\r\n", "naïve Ünïcode 漢字 𝒳ỳ",
    *(prose(s, 1 + 3 * s) for s in range(60)), *("<" * k + "S" * (k % 3) for k in range(1, 12)), "mid<", "<S<P<M",
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("clash", [False, True])
def test_outputs_equal_plain_strings(spark, clash):
    rows = list(enumerate(TEXTS)) + [(None, "a null id"), (3, "again"), (3, "again"), (10**15, "x y z")]
    docs = docs_of(spark, rows, clash)
    want = sorted(((i, *plainly(i, t)) for i, t in rows), key=repr)
    made = fim_pieces.rearranged(docs)
    assert sorted(map(tuple, made.collect()), key=repr) == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    texts = fim_pieces.restored(made.withColumn("text", made.output))
    assert sorted(map(tuple, texts.collect()), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)
    hashed = sorted(map(tuple, fim_pieces.rearranged_digests(docs).collect()), key=repr)
    assert hashed == sorted(((*w[:5], sha(w[5]), sha(dict_text(rows, w))) for w in want), key=repr)


def dict_text(rows, row):
    """The text of a row by its id and output."""
    return next(t or "" for i, t in rows if i == row[0] and plainly(i, t) == row[1:])


def test_no_rows_and_a_long_text(spark):
    assert fim_pieces.rearranged_digests(docs_of(spark, [])).count() == 0
    text = "word, " * 400_000
    assert fim_pieces.rearranged(docs_of(spark, [text])).first()["output"] == plainly(0, text)[4]


def test_pieces_are_views():
    data, offsets = text_arrays.text_buffer(pa.array(["ab", None, "cd"]).slice(1))
    pieces = fim_pieces.cut(data, offsets, offsets[1:, None].repeat(2, 1))
    assert pieces.texts().to_pylist() == ["", "cd"] and pieces.text is data


def test_broken_output():
    with pytest.raises(ValueError, match="lacks <S>"):
        fim_pieces.restore(pa.array(["<P>a<M>b"]), "psm")
    assert fim_pieces.restore(pa.array(["<P>a<S>c<M>b"]), "psm").texts().to_pylist() == ["abc"]

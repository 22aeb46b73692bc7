"""Text columns: stripping, line splitting, wrapping, clean-up of decoded text, file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that Python's str.strip() removes.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Special tokens of the vocabulary, in id order.
UNK, CLS, SEP, PAD, MASK, BOS, EOS = SPECIAL_TOKENS = (
    "[UNK]", "[CLS]", "[SEP]", "[PAD]", "[MASK]", "[BOS]", "[EOS]",
)
NEWLINE = r"\r\n|\r|\n"
# The width of FASTA lines, headers of generated records, times in file names.
FASTA_WIDTH = 60
GENERATED_HEADER = "%s_%d length=%d"
TIME_IN_NAME = "yyyyMMdd_HHmmss"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def stripped_lines(text: Column) -> Column:
    """Array of the non-blank lines of a text, each stripped."""
    lines = F.transform(F.split(text, NEWLINE), strip)
    return F.filter(lines, lambda line: line != "")


def wrap_lines(text: Column, width: int = FASTA_WIDTH) -> Column:
    """Break a text into lines of ``width`` characters, without a trailing newline."""
    return F.regexp_replace(text, f"(?s)(.{{{width}}})(?=.)", "$1\n")


def fasta_record(header: Column, text: Column, width: int = FASTA_WIDTH) -> Column:
    return F.concat(F.lit(">"), header, F.lit("\n"), wrap_lines(text, width))


def generated_header(prefix: str, index: Column, text: Column) -> Column:
    return F.format_string(GENERATED_HEADER, F.lit(prefix), index, F.length(text))


def clean_decoded(text: Column) -> Column:
    """Drop wrapping tokens, padding, unknowns and then spaces; FIM tags stay.

    One replacement after another: a removal may create the next match.
    """
    for literal in (BOS, EOS, PAD, UNK, " "):
        text = F.replace(text, F.lit(literal), F.lit(""))
    return text


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^.]*$", "")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def parent_dir(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def url_path(url: Column) -> Column:
    return F.parse_url(url, F.lit("PATH"))


def url_fragment(url: Column) -> Column:
    return F.parse_url(url, F.lit("REF"))


def stamped_name(stem: str, ts: Column, suffix: str = ".fasta") -> Column:
    """File name carrying a timestamp, as the generator's output files do."""
    return F.concat(F.lit(f"{stem}_"), F.date_format(ts, TIME_IN_NAME), F.lit(suffix))

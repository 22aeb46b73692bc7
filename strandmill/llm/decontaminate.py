"""Benchmark decontamination: windows as long as an item, found by SimHash and checked exactly.

Windows of a document are compared with items of the same length. A window of its own is
looked at for each place where it begins with a shingle of an item; sliding any other window
to the right up to such a place loses no shingle it shares with an item, so none is missed.
Equal windows are handled once. Fingerprints are looked up by blocks of bits: of fingerprints
within the radius, some block differs in few bits, and items are filed under all such values.
What is found is checked by the weighted similarity of the shingles. All is built in functions
of DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.llm.store import how_to_send, semi_join, stored

WIDTH = 5
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A document leaks an item if a window's similarity is at least this many percent.
PERCENT = 80
#: Bits of the fingerprint, in blocks; similar windows differ in 10 bits on average.
BLOCKS = (13, 13, 13, 13, 12)
RADIUS = 19
#: Item shingles that are sent to all tasks at most.
SENT_SHINGLES = 1_000_000


def plain_text(text: Column) -> Column:
    """The text with A-Z as a-z and no ASCII white space around it."""
    return F.translate(F.btrim(text, F.lit(SPACES)), UPPER, LOWER)


def shingle_array(words: str) -> Column:
    """Hashes of all runs of five words of a column in order; of all words if they are fewer."""
    run = ", ".join(f"{words}[i + {step}]" for step in range(WIDTH))
    return F.expr(
        f"if(size({words}) < {WIDTH}, array(xxhash64({words})), "
        f"transform(sequence(0, size({words}) - {WIDTH}), i -> xxhash64({run})))"
    )


def with_shingles(texts: DataFrame, key: str) -> DataFrame:
    """Rows (key, grams) of the texts that have words and whose key is not null."""
    plain = plain_text(F.col("text"))
    words = (
        texts.select(F.col(key).cast("long"), "text").where(F.col(key).isNotNull() & (plain != ""))
        .select(key, F.split(plain, r"[\x20\x09-\x0D]+").alias("words"))
    )
    return words.select(key, shingle_array("words").alias("grams"))


def fingerprint(grams: Column) -> Column:
    """64-bit SimHash: each bit is that of most shingles, repeated ones counted repeatedly."""
    count = lambda bit: F.aggregate(
        grams, F.lit(0).cast("long"),
        lambda total, gram: total + F.shiftrightunsigned(gram, bit).bitwiseAND(1),
    )
    bits = [
        F.when(2 * count(bit) > F.size(grams), F.lit(1 << bit if bit < 63 else -(1 << 63)))
        .otherwise(F.lit(0)).cast("long")
        for bit in range(64)
    ]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return total


def _blocks(print_: Column, flips: bool) -> Column:
    """Rows (block, value) of a fingerprint; with ``flips`` all values that may lie within reach."""
    reach = RADIUS // len(BLOCKS)
    parts, shift = [], 0
    for block, width in enumerate(BLOCKS):
        value = F.shiftrightunsigned(print_, shift).bitwiseAND((1 << width) - 1)
        masks = (
            F.expr(f"filter(sequence(0L, {(1 << width) - 1}L), m -> bit_count(m) <= {reach})")
            if flips else F.array(F.lit(0).cast("long"))
        )
        parts.append(F.transform(masks, _filed(F.lit(block), value)))
        shift += width
    return F.inline(F.concat(*parts))


def _filed(block: Column, value: Column) -> Callable[[Column], Column]:
    return lambda mask: F.struct(block.alias("block"), value.bitwiseXOR(mask).alias("value"))


def item_windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows (doc_id, size, start, w1, w2, grams): windows that begin with a shingle of an item.

    ``size`` is the items' number of shingles; at a text's end the last whole window is taken,
    and a text shorter than the item is one window. ``w1`` and ``w2`` are a digest.
    """
    wanted = items.select(F.explode("grams").alias("gram"), F.size("grams").alias("size")).distinct()
    wanted = stored(wanted, "item-shingles")
    # An outer one, as no filter is then derived from it that would hash all shingles once more.
    places = with_shingles(docs, "doc_id").select(
        "doc_id", "grams", F.posexplode_outer("grams").alias("at", "gram")
    )
    start = F.least("at", F.greatest(F.size("grams") - F.col("size"), F.lit(0)))
    cut = (
        places.join(wanted.hint(how_to_send(wanted, SENT_SHINGLES)), "gram")
        .select("doc_id", "size", start.alias("start"), F.slice("grams", start + 1, F.col("size")).alias("grams"))
    )
    return cut.select(
        "doc_id", "size", "start", F.xxhash64("grams").alias("w1"),
        F.xxhash64(F.lit(1), "grams").alias("w2"), "grams",
    )


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (doc_id, item_id, similarity, n_windows, start) of documents that hold an item.

    The similarity of a window is the sum of the smaller counts of its and the item's shingles
    over the sum of the larger ones; given is the largest, of windows with 0.8 or more,
    the first word of the first such window, and how many windows there are. An item with fewer
    than five words is in texts that consist of it. Null ids, null and empty texts and items,
    and those without a word, have no part in it; rows that share an id count as one document
    (or one item, with all its texts). Other columns are not looked at.
    """
    items = stored(
        with_shingles(benchmark, "item_id").distinct()
        .withColumns({"n": F.size("grams"), "print": fingerprint(F.col("grams")),
                      "text_no": F.xxhash64("grams")}),
        "items",
    )
    windows = stored(item_windows(docs, items), "item-windows")
    kinds = stored(
        windows.select("size", "w1", "w2", "grams").dropDuplicates(["size", "w1", "w2"])
        .withColumns({"n": F.size("grams"), "print": fingerprint(F.col("grams"))}),
        "window-kinds",
    )
    filed = items.select("item_id", "text_no", F.col("n").alias("size"), F.col("print").alias("item_print"),
                         _blocks(F.col("print"), flips=True))
    looked = kinds.select("size", "w1", "w2", "print", _blocks(F.col("print"), flips=False))
    near = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS
    # Filed are some 1,800 rows an item: far more than their plan's estimate, so the hint.
    pairs = stored(
        looked.join(filed.hint("merge"), ["size", "block", "value"]).where(near)
        .select("size", "w1", "w2", "item_id", "text_no").distinct(),
        "fingerprint-pairs",
    )
    of_window = ["size", "w1", "w2"]
    theirs = items.select("item_id", "text_no", F.explode("grams").alias("gram")).groupBy(
        "item_id", "text_no", "gram").agg(F.count("*").alias("theirs"))
    ours = kinds.select(*of_window, F.explode("grams").alias("gram")).groupBy(
        *of_window, "gram").agg(F.count("*").alias("ours"))
    shared = (
        pairs.join(ours, of_window).join(theirs, ["item_id", "text_no", "gram"])
        .groupBy(*of_window, "item_id", "text_no").agg(F.sum(F.least("ours", "theirs")).alias("shared"))
        .join(kinds.select(*of_window, "n"), of_window)
        .withColumn("union", F.col("n") + F.col("size") - F.col("shared"))
        .where(100 * F.col("shared") >= PERCENT * F.col("union"))
    )
    found = stored(
        shared.withColumn("similarity", F.col("shared") / F.col("union")).groupBy(*of_window, "item_id")
        .agg(F.max("similarity").alias("similarity")),
        "item-matches",
    )
    first = F.max(F.struct(F.col("similarity"), (-F.col("start")).alias("back")))
    return (
        windows.select("doc_id", "start", *of_window).join(found, of_window)
        .groupBy("doc_id", "item_id")
        .agg(first.alias("best"), F.count_distinct("size", "start").alias("n_windows"))
        .select("doc_id", "item_id", "best.similarity", "n_windows", (-F.col("best.back")).alias("start"))
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold an item; those without an id all stay."""
    gone = stored(leaks(docs, benchmark).select("doc_id").distinct(), "leaks")
    return semi_join(docs, gone, "doc_id", "left_anti")

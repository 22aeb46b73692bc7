"""WARC not-modified revisits: each takes over what the latest earlier full response said.

An as-of join by canonical URL that keeps no URL's history together: rows are ranged over
(URL, date), each range looks back within itself, and what a URL hands on from one range to the
next is a table with at most a row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.llm.store import stored

NOT_MODIFIED = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
#: Header fields that a not-modified response may send to update a stored one.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that name a campaign and not a resource.
CAMPAIGN = r"^utm_[^=]*(=|$)"


def canonical_url(url: Column) -> Column:
    """One spelling of a URL: no scheme, fragment, user, default port, campaign or final slash.

    The host is lower-cased and loses a leading ``www.``; query parameters are sorted. A URL
    without ``://`` or without a host has none.
    """
    parts = r"^[^:/?#]+://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
    host = F.lower(F.regexp_extract(url, parts, 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r"(:(80|443)?)$", "")
    host = F.regexp_replace(host, r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(url, parts, 2), r"/+$", "")
    params = F.filter(
        F.split(F.regexp_extract(url, parts, 3), "&"),
        lambda p: (p != "") & ~F.regexp_like(p, F.lit(CAMPAIGN)),
    )
    query = F.array_join(F.array_sort(params), "&")
    whole = F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(host != "", whole)


def header_map(block: Column) -> Column:
    """A header block as a map by lower-case name; a repeated field keeps its last line."""
    lines = F.filter(F.split(F.coalesce(block, F.lit("")), r"\r?\n"), lambda s: F.instr(s, ":") > 1)
    pairs = F.transform(lines, lambda s: F.struct(
        F.lower(F.trim(F.substring_index(s, ":", 1))).alias("name"),
        F.trim(F.substr(s, F.instr(s, ":") + 1)).alias("value"),
    ))
    names = F.array_distinct(F.transform(pairs, lambda p: p["name"]))
    values = F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda p: p["name"] == n), -1)["value"])
    return F.map_from_arrays(names, values)


def header_block(fields: Column) -> Column:
    """A map as lines ``name: value`` in the order of their names."""
    lines = F.transform(F.map_entries(fields), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.array_join(F.array_sort(lines), "\n")


def _etag(fields: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(F.element_at(fields, "etag"), r"^[Ww]/", "")


def _same(revisit: Column, full: Column) -> Column:
    """Whether the validators allow a match: the entity tag decides, else the modification date."""
    tag, other = _etag(revisit), _etag(full)
    since = lambda fields: F.element_at(fields, "last-modified")
    by_date = F.coalesce(since(revisit) == since(full), F.lit(False))
    return F.when(tag.isNotNull(), F.coalesce(tag == other, F.lit(False))).otherwise(by_date)


def latest_before(rows: DataFrame, value: Column) -> DataFrame:
    """``rows`` (key, at, serves, id, ...) with ``found``: ``value`` of the latest row before.

    Looks among rows of the same key that serve, with a smaller ``at``; of several at the same
    time the one with the largest id. Keys and times are not null.
    """
    order = [F.col("at"), F.col("serves"), F.col("id")]  # what is asked at a time comes first
    ranged = rows.withColumn("value", F.when(F.col("serves"), value))
    ranged = stored(
        ranged.repartitionByRange("key", *order).withColumn("part", F.spark_partition_id()),
        "asof-ranges",
    )
    # A key lies in several ranges only if it crosses a border: fewer keys than ranges.
    crossing = F.broadcast(
        ranged.groupBy("key").agg(F.min("part").alias("first"), F.max("part").alias("final"))
        .where("first < final").select("key")
    )
    last = F.max_by("value", F.struct("at", "id"))
    handed = (
        ranged.join(crossing, "key", "left_semi").groupBy("key", "part")
        .agg(last.alias("value"))
        .withColumn("before", F.last("value", ignorenulls=True).over(
            Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        ))
        .select("key", "part", "before")
    )
    within = F.last("value", ignorenulls=True).over(
        Window.partitionBy("key", "part").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        ranged.withColumn("within", within)
        .join(F.broadcast(handed), ["key", "part"], "left")
        .withColumn("found", F.coalesce("within", "before"))
        .drop("value", "within", "before", "part")
    )


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per not-modified revisit, with the response it stands for.

    ``records`` has record_id, warc_type, target_uri, warc_date, status, profile, headers (a
    block of lines) and payload_digest; other columns are not looked at. A full response is of
    type ``response`` with status 200. ``outcome`` is ``resolved``; ``changed`` where the latest
    earlier response has another validator (or neither has one); ``missing`` where there is no
    earlier response, or the revisit lacks a URL with a host, or a date. Only a resolved row has
    ``refers_to``, ``headers`` (the response's, with permitted ones of the revisit put over
    them) and ``payload_digest``. A response of the same date is not earlier; of several at one
    date the largest id counts. Repeated records give repeated rows.
    """
    revisit = (F.col("warc_type") == "revisit") & (F.col("profile") == NOT_MODIFIED)
    full = (F.col("warc_type") == "response") & (F.col("status") == 200)
    rows = records.select(
        F.col("record_id").alias("id"), canonical_url(F.col("target_uri")).alias("key"),
        F.col("warc_date").alias("at"), F.coalesce(full, F.lit(False)).alias("serves"),
        F.coalesce(revisit, F.lit(False)).alias("asks"), F.col("headers").alias("block"),
        "payload_digest",
    ).where("serves or asks")
    placed = F.col("key").isNotNull() & F.col("at").isNotNull()
    source = F.struct("id", "block", "payload_digest")
    asked = latest_before(rows.where(placed), source).where("asks")
    lost = rows.where(~placed & F.col("asks")).withColumn(
        "found", F.lit(None).cast(asked.schema["found"].dataType)
    )
    own, theirs = F.col("own"), F.col("theirs")
    allowed = F.map_filter(own, lambda name, _: name.isin(*PERMITTED))
    kept = F.map_filter(theirs, lambda name, _: ~F.map_contains_key(allowed, name))
    ok = F.col("outcome") == "resolved"
    return (
        asked.unionByName(lost.select(asked.columns))
        .withColumn("own", header_map(F.col("block")))
        .withColumn("theirs", header_map(F.col("found.block")))
        .withColumn("outcome", F.when(F.col("found").isNull(), "missing")
                    .when(_same(own, theirs), "resolved").otherwise("changed"))
        .select(
            F.col("id").alias("record_id"), F.col("key").alias("canonical_url"), "outcome",
            F.when(ok, F.col("found.id")).alias("refers_to"),
            F.when(ok, header_block(F.map_concat(kept, allowed))).alias("headers"),
            F.when(ok, F.col("found.payload_digest")).alias("payload_digest"),
        )
    )


def records_from_pages(pages: DataFrame) -> DataFrame:
    """A crawl of ``pages`` (page_id, url, html): a full response per page, and a revisit.

    Dates, header fields and spellings of the URL follow from the page's id, so that revisits
    come before and after responses, and with the response's validators and with others.
    """
    page = F.col("page_id")
    at = F.lit(1_700_000_000) + F.pmod(page * 7919, F.lit(1_000_003))
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    pmod = lambda n: F.pmod(page, F.lit(n))
    changed = F.when(pmod(7) == 0, '"stale"').when(pmod(4) == 1, F.concat(F.lit("W/"), tag)).otherwise(tag)
    later = F.when(pmod(5) == 0, -100).otherwise(F.lit(3600) + pmod(1000))
    text = lambda column: column.cast("string")
    records = F.array(
        F.struct(
            (2 * page).alias("record_id"), F.lit("response").alias("warc_type"),
            F.col("url").alias("target_uri"), at.alias("warc_date"), F.lit(200).alias("status"),
            F.lit(None).cast("string").alias("profile"),
            F.concat(
                F.lit("Content-Type: text/html\nContent-Length: "), text(F.length("html")),
                F.lit("\nETag: "), tag, F.lit("\nDate: "), text(at), F.lit("\nServer: first"),
            ).alias("headers"),
            F.sha2("html", 256).alias("payload_digest"),
        ),
        F.struct(
            (2 * page + 1).alias("record_id"), F.lit("revisit").alias("warc_type"),
            F.when(pmod(3) == 0, F.concat("url", F.lit("#part"))).otherwise(F.col("url")).alias("target_uri"),
            (at + later).alias("warc_date"), F.lit(304).alias("status"),
            F.lit(NOT_MODIFIED).alias("profile"),
            F.concat(
                F.lit("ETag: "), changed, F.lit("\nDate: "), text(at + later),
                F.lit("\nCache-Control: max-age="), text(pmod(60)), F.lit("\nServer: second"),
            ).alias("headers"),
            F.lit(None).cast("string").alias("payload_digest"),
        ),
    )
    return pages.select(F.inline(records))

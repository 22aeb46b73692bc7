"""URL filters: explicit rules, and trust and distrust that spread over links between hosts.

Trust follows links from the hosts of allowed pages (personalised PageRank); distrust follows
links backwards from the hosts of blocked pages. A page that no rule fits takes the verdict of
its host: blocked where distrust makes up more than a given share of both.
"""

from __future__ import annotations

import math
import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.llm.store import how_to_send, stored

URL_PARTS = r"://([^/?#]*)([^?#]*)"
LINKS = r"""(?i)\bhref\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""
DAMPING = 0.85
TOLERANCE = 1e-9
MAX_DISTRUST = 0.5
#: Rows of a table of hosts that are sent to all tasks at most; a larger one is shuffled.
SENT_HOSTS = 500_000

#: A rule is (verdict, host and path), such as ``("block", "example.org/es/")``.
Rule = tuple[str, str]


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, URL_PARTS, 1)
    lowered = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(lowered, F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL_PARTS, 2), F.lit(""))


def host_rules(hosts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows (host, rules): per host the rules for it or for a domain that it lies under."""
    listed = [
        F.struct(
            F.lit(rule.partition("/")[0].lower()).alias("domain"),
            F.lit("/" + rule.partition("/")[2]).alias("prefix"),
            F.lit(len(rule)).alias("length"), F.lit(verdict == "block").alias("blocks"),
            F.lit(rule).alias("rule"),
        )
        for verdict, rule in rules
    ]
    table = hosts.sparkSession.range(1).select(F.inline(F.array(*listed)))
    labels = F.split("host", r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    return (
        hosts.select("host").distinct().select("host", F.explode(domains).alias("domain"))
        .join(table, "domain").groupBy("host")
        .agg(F.collect_list(F.struct("length", "blocks", "rule", "prefix")).alias("rules"))
    )


def fitting_rules(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows (page_id, host, path, rule, ruled): the longest rule that fits each page's url.

    Of equally long rules one that blocks wins. ``ruled`` is its verdict; both are null where
    no rule fits.
    """
    parts = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    if not rules:
        none = F.lit(None).cast("string")
        return parts.select("*", none.alias("rule"), none.alias("ruled"))
    best = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r["prefix"])))
    of_host = stored(host_rules(parts, rules), "host-rules")
    return (
        parts.join(of_host.hint(how_to_send(of_host, SENT_HOSTS)), "host", "left").withColumn("best", best)
        .select(
            "page_id", "host", "path", F.col("best.rule").alias("rule"),
            F.when(F.col("best.blocks"), "block").when(~F.col("best.blocks"), "allow").alias("ruled"),
        )
    )


def host_links(pages: DataFrame) -> DataFrame:
    """Rows (src, dst, n): links from pages of one host to another host."""
    links = pages.select(
        url_host(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINKS), F.lit(1))).alias("link")
    )
    return (
        links.select("src", url_host(F.concat(F.lit(":"), F.regexp_replace("link", "(?i)^https?:", ""))).alias("dst"))
        .where("src <> '' and dst <> '' and src <> dst")
        .groupBy("src", "dst").agg(F.count("*").alias("n"))
    )


def _shares(links: DataFrame, kind: str, start: str, end: str) -> DataFrame:
    """Rows (kind, host, to, share): how what a host has is dealt out over its links."""
    total = links.groupBy(start).agg(F.sum("n").alias("total"))
    return links.join(total, start).select(
        F.lit(kind).alias("kind"), F.col(start).alias("host"), F.col(end).alias("to"),
        (F.col("n") / F.col("total")).alias("share"),
    )


def rounds_to(tolerance: float = TOLERANCE, damping: float = DAMPING) -> int:
    """Rounds after which the scores change by no more than ``tolerance``, on any graph."""
    return math.ceil(math.log(tolerance) / math.log(damping))


def propagate(
    links: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE,
) -> DataFrame:
    """Rows (host, trust, distrust) from ``seeds`` (host, allowed, blocked) over ``links``.

    Rounds end when the scores change by no more than ``tolerance`` of the seeds' weight: each
    moves at most ``damping`` of what the one before moved. Each round is written, so a lost
    executor costs one round at most.
    """
    links = stored(links, "host-links")
    steps = stored(
        _shares(links, "trust", "src", "dst").unionByName(_shares(links, "distrust", "dst", "src")),
        "host-shares",
    )
    base = stored(
        seeds.select("host", F.inline(F.array(
            F.struct(F.lit("trust").alias("kind"), (F.col("allowed") * (1 - damping)).alias("score")),
            F.struct(F.lit("distrust").alias("kind"), (F.col("blocked") * (1 - damping)).alias("score")),
        ))).where("score > 0").select("kind", "host", "score"),
        "host-seeds",
    )
    weight = base.agg(F.sum("score")).first()[0] or 0.0
    scores = base
    while weight:
        sent = scores.join(steps, ["kind", "host"]).groupBy("kind", "to").agg(
            F.sum(damping * F.col("score") * F.col("share")).alias("score")
        )
        new = stored(
            base.unionByName(sent.withColumnRenamed("to", "host"))
            .groupBy("kind", "host").agg(F.sum("score").alias("score")),
            "host-scores",
        )
        old = scores.select("kind", "host", (-F.col("score")).alias("score"))
        moved = (
            new.unionByName(old).groupBy("kind", "host").agg(F.abs(F.sum("score")).alias("moved"))
            .agg(F.sum("moved")).first()[0]
        )
        scores = new
        if moved <= tolerance * weight:
            break
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0))
    return scores.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust"))


def judge_pages(
    pages: DataFrame, rules: Sequence[Rule], max_distrust: float = MAX_DISTRUST
) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, trust, distrust), one per page.

    ``pages`` has page_id, url and html; other columns are not looked at. A null url, and one
    without ``://``, has an empty host and path: no rule fits, no score reaches it, it is
    allowed. So is a host that neither trust nor distrust reaches. A null html has no links.
    Repeated rows are judged, and counted as seeds, one by one.
    """
    judged = fitting_rules(pages, rules)
    count = lambda verdict: F.count(F.when(F.col("ruled") == verdict, 1))
    seeds = judged.where("host <> '' and ruled is not null").groupBy("host").agg(
        count("allow").alias("allowed"), count("block").alias("blocked")
    )
    scores = stored(propagate(host_links(pages), seeds), "host-verdicts")
    both = F.col("trust") + F.col("distrust")
    blocked = F.round(F.col("distrust") / both, 9) > max_distrust
    by_method = F.when(blocked, "block").otherwise("allow")
    return judged.join(scores.hint(how_to_send(scores, SENT_HOSTS)), "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", by_method).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )

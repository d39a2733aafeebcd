"""Verdicts on page urls: rules first, then trust and distrust spread over the links between hosts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import stored, unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?is)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    """``verdict`` (allow or block) for a host with its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def lowered(host: Column) -> Column:
    return F.translate(host, UPPER, LOWER)


def with_host_and_path(pages: DataFrame) -> DataFrame:
    """Add host and path of the url; both empty for a null url or one without ``://``."""
    url = F.coalesce("url", F.lit(""))
    return pages.withColumn("host", lowered(F.regexp_extract(url, URL, 1))).withColumn("path", F.regexp_extract(url, URL, 2))


def fitting_rule(rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits host and path, null without one.

    Among rules of one text the block rule wins. The list is part of the plan: keep it to
    some hundred rules.
    """
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.verdict == "block")):
        fits = ((F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)) & F.col("path").startswith(rule.path)
        text, verdict = F.when(fits, F.lit(rule.text)).otherwise(text), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """(source, target, links): how often pages of a host link to another one, by absolute href and src."""
    found = F.when(F.contains("html", F.lit("//")), F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))
    links = pages.select(F.col("host").alias("source"), F.explode(found).alias("target")).withColumn("target", lowered(F.col("target")))
    return links.where("source <> '' and source <> target").groupBy("source", "target").agg(F.count("*").alias("links"))


def spread_trust(links: DataFrame, seeds: DataFrame, rounds: int, damping: float) -> DataFrame:
    """(host, trust, distrust) after ``rounds`` rounds; hosts that have none are left out.

    ``seeds`` has host, trusted, blocked: numbers of pages. Personalised PageRank, multiplied by the number of seeds, so
    that a host's score hangs on the seeds it has a path to and not on how many others there are: each round a host has 1 -
    ``damping`` of its own seeds and what comes in over links. Trust follows links, shared out over a host's links; distrust
    goes back from a linked host to those that link to it, shared out over them. Hosts without links
    onwards lose what they would pass on. Each second round is written to the shared folder.
    """
    out_total = links.groupBy("source").agg(F.sum("links").alias("total"))
    in_total = links.groupBy("target").agg(F.sum("links").alias("total"))
    forth = links.join(out_total, "source").select(F.col("source").alias("frm"), F.col("target").alias("to"),
                                                   (F.col("links") / F.col("total")).alias("t"), F.lit(0.0).alias("d"))
    back = links.join(in_total, "target").select(F.col("target").alias("frm"), F.col("source").alias("to"),
                                                 F.lit(0.0).alias("t"), (F.col("links") / F.col("total")).alias("d"))
    edges = stored(forth.union(back), "host-edges")
    seeds = stored(seeds, "host-seeds")
    keep = 1.0 - damping
    at = seeds.select("host", (keep * F.col("trusted")).alias("trust"), (keep * F.col("blocked")).alias("distrust"))
    for r in range(rounds):
        got = edges.join(at.withColumnRenamed("host", "frm"), "frm").groupBy(F.col("to").alias("host")).agg(
            F.sum(damping * F.col("trust") * F.col("t")).alias("trust"), F.sum(damping * F.col("distrust") * F.col("d")).alias("distrust"))
        if r % 2 or r == rounds - 1:
            got = stored(got, "host-trust")
        at = got.join(seeds, "host", "full").select(
            "host", (F.coalesce("trust", F.lit(0.0)) + keep * F.coalesce("trusted", F.lit(0.0))).alias("trust"),
            (F.coalesce("distrust", F.lit(0.0)) + keep * F.coalesce("blocked", F.lit(0.0))).alias("distrust"))
    return at


def judge_urls(pages: DataFrame, rules: list[Rule], rounds: int = 8, damping: float = 0.85, least_distrust: float = 0.01) -> DataFrame:
    """Add host, path, rule, trust, distrust and verdict to ``pages`` (page_id, url, html and others; columns of these names are replaced).

    A rule's verdict holds where one fits (the longest). Elsewhere the host decides: it is blocked
    if its distrust is at least ``least_distrust`` and greater than its trust (both to nine decimals).
    Seeds are hosts with the number of their pages that a rule allows (trusted) or blocks (blocked), own seeds
    included, so pages elsewhere do not change a verdict. Null html has no links, a null or broken url the host '' without trust. Repeated pages count
    as often as they stand there. Native DataFrame functions only; shuffled are one row a task for each
    pair of linked hosts and, for the verdict, the pages without their html.
    """
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "trust", "distrust", "verdict")]
    pages = with_host_and_path(pages.select(names))
    text, verdict = fitting_rule(rules)
    own = unused("ruled", names)
    ruled = pages.withColumn("rule", text).withColumn(own, verdict)
    links = stored(host_links(pages), "host-links")
    seeds = ruled.where("host <> ''").groupBy("host").agg(
        F.count_if(F.col(own) == "allow").alias("trusted"), F.count_if(F.col(own) == "block").alias("blocked")).where("trusted + blocked > 0")
    scores = spread_trust(links, seeds, 0 if links.isEmpty() else rounds, damping)
    trust, distrust = (F.round(F.coalesce(c, F.lit(0.0)), 9) for c in ("trust", "distrust"))
    bad = (distrust >= least_distrust) & (distrust > trust)
    return ruled.join(scores, "host", "left").select(
        *names, "host", "path", "rule", trust.alias("trust"), distrust.alias("distrust"),
        F.coalesce(own, F.when(bad, "block").otherwise("allow")).alias("verdict"))
